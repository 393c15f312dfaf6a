"""The checks as frames: every difference, not a sample. Limits belong to the evidence, which sorts first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import compared, percentage_of, within_percentage
from ..functions.predicates import columns_of
from ..functions.values import NUMBER, is_blank, key_part, not_a_number, number
from .keyed import Keyed, duplicates, key_sets, pairs

MISSING, UNEXPECTED = "missing_in_target", "unexpected_in_target"
OPERATIONS = ("count", "distinct_count", "sum")


def key_integrity(side: Keyed) -> DataFrame:
    """K1: key columns and extra_rows."""
    return duplicates(side)


def coverage(source: Keyed, target: Keyed, flag: str | None = None) -> DataFrame:
    """K2: key columns and difference of each key that one side lacks."""
    sets = key_sets(source, target, flag)
    kind = F.when(~F.col("in_target"), MISSING).when(~F.col("in_source"), UNEXPECTED)
    return sets.withColumn("difference", kind).where("difference is not null").select(*source.keys, "difference")


def coverage_counts(source: Keyed, target: Keyed, flag: str | None = None) -> DataFrame:
    """K2: matched, missing_in_target and unexpected_in_target as one row."""
    s, t = F.col("in_source"), F.col("in_target")
    return key_sets(source, target, flag).agg(F.count_if(s & t).alias("matched"), F.count_if(s & ~t).alias(MISSING), F.count_if(~s & t).alias(UNEXPECTED))


def field_pairs(source: Keyed, target: Keyed, check: Mapping, eligible: str | None = None, unique: bool = False) -> DataFrame:
    """K3: key columns, source, target, normalized_source, normalized_target, absolute_difference, percentage_difference, equal for each pair that is compared."""
    both = pairs(source, target, [check["source"]], [check["target"]], unique)
    if eligible:
        both = both.where(F.col(f"sf_{eligible}") & F.col(f"tf_{eligible}"))
    c = compared(F.col("s_0"), F.col("t_0"), check)
    return both.select(
        *source.keys,
        F.col("s_0").cast("string").alias("source"),
        F.col("t_0").cast("string").alias("target"),
        c.source.alias("normalized_source"),
        c.target.alias("normalized_target"),
        c.difference.cast("double").alias("absolute_difference"),
        c.percentage.cast("double").alias("percentage_difference"),
        c.equal.alias("equal"),
    )


def mismatches(source: Keyed, target: Keyed, check: Mapping, eligible: str | None = None, unique: bool = False) -> DataFrame:
    """K3: ``field_pairs`` that are not equal."""
    return field_pairs(source, target, check, eligible, unique).where(~F.col("equal")).drop("equal")


def total(c: Column, when: Column) -> list[Column]:
    """K4: the sum of a field and the number of cells that are no number, over the rows where ``when`` holds."""
    return [F.coalesce(F.sum(F.when(when, number(c))), F.lit(0)).cast(NUMBER).alias("total"), F.count_if(when & not_a_number(c)).alias("bad")]


def one_row(s: DataFrame, t: DataFrame) -> DataFrame:
    """Two frames of one row each, as one row."""
    return s.unionByName(t, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in (*s.columns, *t.columns)])


def control_total(source: Keyed, target: Keyed, check: Mapping, flag: str | None = None) -> DataFrame:
    """K4: source_total, target_total, absolute_difference, bad (cells that are no number) as one row."""
    every = F.col(flag) if flag else F.lit(True)
    s = source.rows.agg(*total(source.column(check["source"]), every)).select(F.col("total").alias("source_total"), F.col("bad").alias("source_bad"))
    t = target.rows.agg(*total(target.column(check["target"]), every)).select(F.col("total").alias("target_total"), F.col("bad").alias("target_bad"))
    return one_row(s, t).select("source_total", "target_total", F.abs(F.col("source_total") - F.col("target_total")).alias("absolute_difference"), (F.col("source_bad") + F.col("target_bad")).alias("bad"))


def row_count(source: Keyed, target: Keyed, flag: str | None = None) -> DataFrame:
    """K5: source_rows, target_rows, absolute_difference as one row."""
    n = F.count_if(F.col(flag)) if flag else F.count(F.lit(1))
    s, t = source.rows.agg(n.alias("source_rows")), target.rows.agg(n.alias("target_rows"))
    return one_row(s, t).withColumn("absolute_difference", F.abs(F.col("source_rows") - F.col("target_rows")))


def grouped(side: Keyed, by: Sequence[str], operation: str, value: str | None, flag: str | None, name: str) -> DataFrame:
    """``g0``, ``g1``, ... and the aggregate of each group, and how many cells were no number."""
    rows = side.rows.where(F.col(flag)) if flag else side.rows
    keys = [key_part(side.column(g)).alias(f"g{i}") for i, g in enumerate(by)]
    bad = F.lit(0).cast("long")
    if operation == "count":
        out = F.count(F.lit(1)).cast(NUMBER)
    elif operation == "distinct_count":
        out = F.count_distinct(key_part(side.column(value))).cast(NUMBER)
    else:
        out = F.sum(number(side.column(value))).cast(NUMBER)
        bad = F.count_if(not_a_number(side.column(value)))
    return rows.groupBy(*keys).agg(out.alias(name), bad.alias(f"{name}_bad"))


def aggregate_match(source: Keyed, target: Keyed, check: Mapping, flag: str | None = None) -> DataFrame:
    """K6: groups with source_value, target_value, absolute_difference, percentage_difference, bad and passed."""
    operation = check.get("operation", "count")
    s = grouped(source, [check["group_by"]["source"]] if isinstance(check["group_by"]["source"], str) else check["group_by"]["source"], operation, check.get("source"), flag, "source_value")
    t = grouped(target, [check["group_by"]["target"]] if isinstance(check["group_by"]["target"], str) else check["group_by"]["target"], operation, check.get("target"), flag, "target_value")
    keys = [c for c in s.columns if c.startswith("g") and c[1:].isdigit()]
    both = s.join(t, keys, "full_outer")
    both = both.withColumns({v: F.coalesce(v, F.lit(0).cast(NUMBER)) for v in ("source_value", "target_value")})
    both = both.withColumn("absolute_difference", F.abs(F.col("source_value") - F.col("target_value")))
    passed = F.col("absolute_difference") <= F.lit(str(check.get("tolerance", 0))).cast(NUMBER)
    if check.get("percentage_tolerance") is not None:
        passed = passed | within_percentage(F.col("source_value"), F.col("absolute_difference"), check["percentage_tolerance"])
    bad = F.coalesce("source_value_bad", F.lit(0)) + F.coalesce("target_value_bad", F.lit(0))
    return both.select(*keys, "source_value", "target_value", "absolute_difference", percentage_of(F.col("source_value"), F.col("absolute_difference")).alias("percentage_difference"), bad.alias("bad"), passed.alias("passed"))


def profile_blank(frame: DataFrame, name: str) -> Column:
    """Whether a cell counts as missing in a profile."""
    return is_blank(columns_of(frame, "dataset")(name))
