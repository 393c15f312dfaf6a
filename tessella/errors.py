"""Errors that a user can act on."""


class TessellaError(Exception):
    """Base of the errors below; the command line turns it into exit code 2."""


class SpecError(TessellaError):
    """A specification is not valid."""


class DataError(TessellaError):
    """An input can't be read, or its values can't be what the specification needs."""
