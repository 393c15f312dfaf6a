"""Reconciliation of keyed datasets, and data processing at scale, on Spark."""

from .errors import DataError, SpecError, TessellaError

__all__ = ["DataError", "SpecError", "TessellaError", "load_spec", "reconcile", "validate_spec"]
__version__ = "0.1.0"


def __getattr__(name: str):
    """The spec compiler is loaded when it is asked for."""
    if name in ("load_spec", "validate_spec"):
        from .plans import spec

        return getattr(spec, name)
    if name == "reconcile":
        from .plans.run import reconcile

        return reconcile
    raise AttributeError(name)
