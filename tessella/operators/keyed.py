"""Keyed frames: rows with business-key columns ``__k0``, ``__k1``, ... and a running order ``__ord``.

Keys are strings and never null, so that keyed frames join on plain equality and both sides of every check
can share one hash partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import columns_of, compiled
from ..functions.values import DEFAULT, key_part


def listed(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def key_names(n: int) -> list[str]:
    return [f"__k{i}" for i in range(n)]


def key_array(n: int) -> Column:
    """The key as one array column."""
    return F.array(*key_names(n))


@dataclass(frozen=True)
class Keyed:
    """A side of a reconciliation."""

    rows: DataFrame
    width: int
    side: str = "source"
    flags: tuple[str, ...] = field(default=())

    @property
    def keys(self) -> list[str]:
        return key_names(self.width)

    def column(self, name: str) -> Column:
        return columns_of(self.rows, self.side)(name)

    def where(self, predicate: Mapping | None) -> "Keyed":
        return self if not predicate else Keyed(self.rows.where(compiled(predicate, self.column)), self.width, self.side, self.flags)

    def flagged(self, flags: Mapping[str, Column]) -> "Keyed":
        return Keyed(self.rows.withColumns(dict(flags)), self.width, self.side, (*self.flags, *flags))

    def cached(self) -> "Keyed":
        return Keyed(self.rows.persist(), self.width, self.side, self.flags)


def keyed(frame: DataFrame, key: str | Sequence[str], chain: Sequence[str] | None = DEFAULT, side: str = "source") -> Keyed:
    """``frame`` with its key columns, and the order of its rows.

    Rows read from files are ordered by file, place of the split in it, and row. What is made of several tables has
    an order that holds for its plan only.
    """
    names, column = listed(key), columns_of(frame, side)
    parts = {k: key_part(column(n), chain) for k, n in zip(key_names(len(names)), names, strict=True)}
    row = F.monotonically_increasing_id()
    try:
        rows = frame.withColumns(parts).withColumn("__ord", F.struct(F.input_file_name(), F.input_file_block_start(), row))
    except AnalysisException:
        rows = frame.withColumns(parts).withColumn("__ord", F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("at"), row.alias("row")))
    return Keyed(rows, len(names), side)


def first_rows(side: Keyed) -> Keyed:
    """One row a key, the first; streams through a sort instead of gathering a key's rows."""
    place = F.row_number().over(W.partitionBy(*side.keys).orderBy("__ord"))
    return Keyed(side.rows.withColumn("__place", place).where("__place = 1").drop("__place"), side.width, side.side, side.flags)


def duplicates(side: Keyed) -> DataFrame:
    """key columns and ``extra_rows`` of keys that have more than one row."""
    return side.rows.groupBy(*side.keys).agg((F.count(F.lit(1)) - 1).alias("extra_rows")).where("extra_rows > 0")


def key_sets(source: Keyed, target: Keyed, flag: str | None = None) -> DataFrame:
    """key columns, ``in_source``, ``in_target`` of all distinct keys: one full outer join of two aggregates.

    flag: a boolean column on both sides; only keys of rows where it holds count.
    """

    def one(side: Keyed, name: str) -> DataFrame:
        rows = side.rows.where(F.col(flag)) if flag else side.rows
        return rows.groupBy(*side.keys).agg(F.lit(True).alias(name))

    both = one(source, "in_source").join(one(target, "in_target"), source.keys, "full_outer")
    return both.withColumns({n: F.coalesce(n, F.lit(False)) for n in ("in_source", "in_target")})


def pairs(source: Keyed, target: Keyed, source_fields: Sequence[str], target_fields: Sequence[str], unique: bool = False) -> DataFrame:
    """key columns and the fields of matched first rows, as ``s_<i>`` and ``t_<i>`` in the order given.

    unique: both sides are known to have one row a key, and need no deduplication.
    """
    s, t = (x if unique else first_rows(x) for x in (source, target))
    left = s.rows.select(*s.keys, *[s.column(f).alias(f"s_{i}") for i, f in enumerate(source_fields)], *[F.col(f).alias(f"sf_{f}") for f in s.flags])
    right = t.rows.select(*t.keys, *[t.column(f).alias(f"t_{i}") for i, f in enumerate(target_fields)], *[F.col(f).alias(f"tf_{f}") for f in t.flags])
    return left.join(right, s.keys)
