"""The closed predicate language, compiled to boolean columns that are never null."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from datetime import datetime
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DataError, SpecError
from .values import NORMALIZERS, is_blank, moment, normalize, normalize_literal

OPERATORS = ("eq", "ne", "in", "not_in", "contains", "starts_with", "is_null", "not_null", "gt", "gte", "lt", "lte")
ORDERED = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def check(predicate: object, at: str) -> None:
    """Raises SpecError unless ``predicate`` is well formed."""
    if not isinstance(predicate, Mapping) or not predicate:
        raise SpecError(f"{at} must be a mapping")
    joined = [k for k in ("all", "any", "not") if k in predicate]
    if joined:
        if len(predicate) != 1:
            raise SpecError(f"{at}: {joined[0]} stands alone")
        inner = predicate[joined[0]]
        if joined[0] == "not":
            check(inner, f"{at}.not")
            return
        if not isinstance(inner, list) or not inner:
            raise SpecError(f"{at}.{joined[0]} must be a list that is not empty")
        for k, p in enumerate(inner):
            check(p, f"{at}.{joined[0]}[{k}]")
        return
    if extra := set(predicate) - {"field", "op", "value", "normalize"}:
        raise SpecError(f"{at}: unknown {', '.join(sorted(extra))}")
    if not isinstance(predicate.get("field"), str) or not predicate["field"]:
        raise SpecError(f"{at}.field must name a field")
    op = predicate.get("op", "eq")
    if op not in OPERATORS:
        raise SpecError(f"{at}.op must be one of {', '.join(OPERATORS)}")
    if op not in ("is_null", "not_null") and "value" not in predicate:
        raise SpecError(f"{at}: {op} needs a value")
    if op in ("in", "not_in") and not isinstance(predicate["value"], list):
        raise SpecError(f"{at}: {op} needs a list")
    chain = predicate.get("normalize", [])
    if not isinstance(chain, list) or any(o not in NORMALIZERS for o in chain):
        raise SpecError(f"{at}.normalize must list normalizers")


def fields(predicate: Mapping | None) -> set[str]:
    """All fields that a predicate reads."""
    if not predicate:
        return set()
    if "not" in predicate:
        return fields(predicate["not"])
    inner = predicate.get("all") or predicate.get("any")
    return set().union(*map(fields, inner)) if inner else {predicate["field"]}


def _number(value: object) -> bool:
    try:
        return not isinstance(value, bool) and Decimal(str(value).replace(",", "")).is_finite()
    except InvalidOperation:
        return False


def _moment(value: object) -> bool:
    try:
        return re.match(r"\d{4}-\d{2}-\d{2}", str(value)) is not None and datetime.fromisoformat(str(value).replace("Z", "+00:00")) is not None
    except ValueError:
        return False


def ordered(op: str, c: Column, value: object, chain: list[str] | None) -> Column:
    """Compares as numbers or as moments if the literal is one and the cell parses as one, else as strings."""
    compare: Callable[[Column, Column], Column] = ORDERED[op]
    left, right = normalize(c, chain), normalize_literal(value, chain)
    plain = compare(left, right)
    if _number(value):
        n = F.regexp_replace(left, ",", "").try_cast("decimal(38,10)")
        return F.when(n.isNotNull(), compare(n, F.lit(str(value).replace(",", "")).cast("decimal(38,10)"))).otherwise(plain)
    if _moment(value):
        t = moment(left)
        return F.when(t.isNotNull(), compare(t, F.lit(str(value)).cast("timestamp"))).otherwise(plain)
    return plain


def compiled(predicate: Mapping, column: Callable[[str], Column]) -> Column:
    """A column that is true where the predicate holds. ``column`` gives the column of a field."""
    if "all" in predicate:
        return reduce(lambda a, b: a & b, [compiled(p, column) for p in predicate["all"]])
    if "any" in predicate:
        return reduce(lambda a, b: a | b, [compiled(p, column) for p in predicate["any"]])
    if "not" in predicate:
        return ~compiled(predicate["not"], column)
    c, op, value, chain = column(predicate["field"]), predicate.get("op", "eq"), predicate.get("value"), predicate.get("normalize")
    if op == "is_null":
        return is_blank(c)
    if op == "not_null":
        return ~is_blank(c)
    left = normalize(c, chain)
    if op in ("in", "not_in"):
        wanted = [v for v in value if v is not None]
        found = F.coalesce(left.isin([normalize_literal(v, chain) for v in wanted]), F.lit(False)) if wanted else F.lit(False)
        if len(wanted) < len(value):
            found = found | left.isNull()
        return found if op == "in" else ~found
    right = normalize_literal(value, chain)
    if op == "eq":
        return left.eqNullSafe(right)
    if op == "ne":
        return ~left.eqNullSafe(right)
    if op in ("contains", "starts_with"):
        return F.coalesce(F.contains(left, right) if op == "contains" else F.startswith(left, right), F.lit(False))
    return F.coalesce(ordered(op, c, value, chain), F.lit(False))


def columns_of(frame, what: str) -> Callable[[str], Column]:
    """Looks fields up in a frame by their exact names; a field that is not there is a DataError."""
    known = {c: c for c in frame.columns}

    def column(name: str) -> Column:
        if name not in known:
            raise DataError(f"{what} has no column {name!r}")
        return F.col("`" + name.replace("`", "``") + "`")

    return column
