"""Business objects: children that belong to roots, and failures rolled up to the object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import DEFAULT, key_part
from .keyed import Keyed, listed


def parent_columns(child: Keyed, parent_key: str | Sequence[str], chain: Sequence[str] | None = DEFAULT) -> list[Column]:
    """The normalized parent key of each child row as ``p0``, ``p1``, ..."""
    return [key_part(child.column(f), chain).alias(f"p{i}") for i, f in enumerate(listed(parent_key))]


def orphans(child: Keyed, parent_key: str | Sequence[str], roots: Keyed, chain: Sequence[str] | None = DEFAULT) -> DataFrame:
    """Key columns and p0, ... of child rows whose parent is not among the roots of their own side.

    Neither side is to be filtered. An anti join on the parent key; the optimizer broadcasts the roots only if
    they are small.
    """
    rows = child.rows.select(*child.keys, *parent_columns(child, parent_key, chain))
    known = roots.rows.select(*[F.col(k).alias(f"p{i}") for i, k in enumerate(roots.keys)]).distinct()
    return rows.join(known, [f"p{i}" for i in range(roots.width)], "left_anti")


def object_path(root: str, parents: Sequence[str], collection: str, keys: Sequence[str]) -> Column:
    """type/parent/collection/child key."""
    return F.concat_ws("/", F.lit(root), *parents, F.lit(collection), *keys)


def roll_up(failures: DataFrame) -> DataFrame:
    """Object (array of strings), failed_checks and paths from rows of (object, check_id, path)."""
    return failures.groupBy("object").agg(F.array_sort(F.collect_set("check_id")).alias("failed_checks"), F.array_sort(F.collect_set("path")).alias("paths"))
