"""When two cells are equal."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import is_blank, mapped, moment, normalize, number


class Compared(NamedTuple):
    equal: Column
    source: Column
    target: Column
    difference: Column  # absolute, numeric modes only
    percentage: Column


def within_percentage(source: Column, difference: Column, limit: object) -> Column:
    """difference / |source| * 100 <= limit; a source of 0 allows no difference.

    By cross multiplication with whole numbers, which is exact, wherever both products fit into 38 digits; beyond
    that in double precision.
    """
    top = Decimal(str(limit))
    scale = max(0, -top.as_tuple().exponent)
    share, whole = int(top.scaleb(scale)), 10 ** (scale + 2)
    in_doubles = difference.cast("double") / F.abs(source).cast("double") * 100 <= F.lit(float(top))
    digits = 37 - max(len(str(whole)), len(str(abs(share))))
    if digits > 10:
        fits = lambda c, by: c.try_cast(f"decimal({digits},10)") * F.lit(str(by)).cast(f"decimal({len(str(abs(by)))},0)")
        in_doubles = F.coalesce(fits(difference, whole) <= fits(F.abs(source), share), in_doubles)
    return F.when(source == 0, difference == 0).otherwise(in_doubles)


def percentage_of(source: Column, difference: Column) -> Column:
    """The percentage as a double; null where a difference meets a source of 0."""
    d, s = difference.cast("double"), F.abs(source).cast("double")
    return F.when(difference == 0, F.lit(0.0)).when(source == 0, F.lit(None).cast("double")).otherwise(d / s * 100)


def compared(source: Column, target: Column, check: Mapping) -> Compared:
    """The comparison that a field check asks for: its null rule, then its map, then dates, numbers or text."""
    a, b = normalize(source, check.get("normalize")), normalize(target, check.get("normalize"))
    rule = check.get("null_semantics", "equal")
    if rule == "empty_is_null":
        a, b = F.when(~is_blank(a), a), F.when(~is_blank(b), b)
    refused = (is_blank(a) | is_blank(b)) if rule == "never_equal" else None
    a = mapped(a, check.get("map"))
    none = F.lit(None)
    difference = percentage = none
    if "date_tolerance_days" in check:
        x, y = moment(a), moment(b)
        limit = round(float(check["date_tolerance_days"]) * 86_400_000_000)
        apart = F.abs(F.unix_micros(x) - F.unix_micros(y))
        equal = F.when(x.isNull() & y.isNull(), F.lit(True)).when(x.isNull() | y.isNull(), F.lit(False)).otherwise(apart <= limit)
        difference = apart.cast("double") / 86_400_000_000
    elif "numeric_tolerance" in check or "percentage_tolerance" in check:
        x, y = number(a), number(b)
        difference = F.abs(x - y)
        percentage = percentage_of(x, difference)
        equal = F.lit(False)
        if "numeric_tolerance" in check:
            equal = equal | (difference <= F.lit(str(check["numeric_tolerance"])).cast("decimal(38,10)"))
        if "percentage_tolerance" in check:
            equal = equal | within_percentage(x, difference, check["percentage_tolerance"])
        equal = F.coalesce(equal, F.lit(False))
    else:
        equal = a.eqNullSafe(b)
    if refused is not None:
        equal = equal & ~refused
    return Compared(equal, a, b, difference, percentage)
