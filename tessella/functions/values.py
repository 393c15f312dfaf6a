"""Normalizers and parsers as column expressions.

White space is what Unicode calls so, digits are ASCII digits, and numbers are DECIMAL(38, 10).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SpecError

NUMBER = "decimal(38,10)"
DEFAULT = ("trim",)
#: Entries of a map that are searched one by one.
LARGE = 32
#: All characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def text(c: Column) -> Column:
    """The value as it is compared: a string."""
    return c.cast("string")


def strip(c: Column) -> Column:
    return F.btrim(text(c), F.lit(WHITE))


def is_blank(c: Column) -> Column:
    """True for null and for white space only; never null."""
    return F.coalesce(strip(c) == "", F.lit(True))


def strip_leading_zeros(c: Column) -> Column:
    """Only where an optional minus is followed by digits alone; the last digit stays."""
    c = text(c)
    return F.when(c.rlike(r"\A-?[0-9]+\z"), F.regexp_replace(c, r"\A(-?)0+(?=[0-9])", "$1")).otherwise(c)


NORMALIZERS = {
    "trim": strip,
    "uppercase": lambda c: F.upper(text(c)),
    "lowercase": lambda c: F.lower(text(c)),
    "empty_to_null": lambda c: F.when(~is_blank(c), text(c)),
    "strip_leading_zeros": strip_leading_zeros,
}


def normalize(c: Column, operations: Sequence[str] | None = DEFAULT) -> Column:
    """The operations in order; none given means trim."""
    operations = operations or DEFAULT
    unknown = [o for o in operations if o not in NORMALIZERS]
    if unknown:
        raise SpecError(f"unknown normalizer {unknown[0]!r}; known are {', '.join(sorted(NORMALIZERS))}")
    return reduce(lambda x, o: NORMALIZERS[o](x), operations, text(c))


def normalize_literal(value: object, operations: Sequence[str] | None = DEFAULT) -> Column:
    """A literal after the same operations; folded to a constant by the optimizer."""
    if value is None:
        return F.lit(None).cast("string")
    if isinstance(value, bool):
        value = str(value)
    return normalize(F.lit(str(value)), operations)


def key_part(c: Column, operations: Sequence[str] | None = DEFAULT) -> Column:
    """A component of a business key: never null."""
    return F.coalesce(normalize(c, operations), F.lit(""))


def number(c: Column) -> Column:
    """The value as a number: thousands commas go, blank is 0, anything else that is no number is null."""
    return F.when(is_blank(c), F.lit(0).cast(NUMBER)).otherwise(F.regexp_replace(strip(c), ",", "").try_cast(NUMBER))


def not_a_number(c: Column) -> Column:
    return number(c).isNull()


def moment(c: Column) -> Column:
    """An ISO date or date-time as a timestamp, else null."""
    s = strip(c)
    return F.when(s.rlike(r"\A\d{4}-\d{2}-\d{2}"), s.try_cast("timestamp"))


def mapped(c: Column, table: Mapping[str, str] | None) -> Column:
    """The table's value for ``c``; what the table does not know passes.

    A map is searched entry by entry, so a large table is dealt into maps of a few entries each by a checksum.
    """
    if not table:
        return c
    if len(table) <= LARGE:
        pairs = [F.lit(str(x)) for kv in table.items() for x in kv]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)
    parts: list[dict[str, str]] = [{} for _ in range(len(table) // 4)]
    for k, v in table.items():
        parts[crc32(str(k).encode()) % len(parts)][str(k)] = str(v)
    maps = F.from_json(F.lit(json.dumps(parts)), "array<map<string,string>>")
    own = F.get(maps, (F.crc32(c.cast("binary")) % len(parts)).cast("int"))
    return F.coalesce(F.try_element_at(own, c), c)


def decimal_text(value: object) -> str | None:
    """A number as text without exponent and without zeros at the end; -0 is 0."""
    if value is None:
        return None
    out = format(value, "f")
    out = out.rstrip("0").rstrip(".") if "." in out else out
    return "0" if out in ("-0", "") else out
