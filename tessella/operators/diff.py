"""Differences between two runs: defects and check states, by full outer joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest_column


def identity(check_id: Column, check_type: Column, locator: Column) -> Column:
    """What makes two defects of different runs the same one."""
    return digest_column(F.struct(check_id.alias("check_id"), locator.alias("locator"), check_type.alias("type")))


def classified(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``identity`` and ``class`` (new, resolved, persistent, changed) from frames of (identity, content)."""
    b = baseline.select("identity", F.col("content").alias("before"), F.lit(True).alias("in_baseline"))
    c = current.select("identity", F.col("content").alias("after"), F.lit(True).alias("in_current"))
    kind = F.when(F.col("in_baseline").isNull(), "new").when(F.col("in_current").isNull(), "resolved").when(F.col("before").eqNullSafe(F.col("after")), "persistent").otherwise("changed")
    return b.join(c, "identity", "full_outer").withColumn("class", kind).select("identity", "class", "before", "after")


def transitions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """check_id and ``transition`` from frames of (check_id, status, severity)."""
    b = baseline.select("check_id", F.col("status").alias("s0"), F.col("severity").alias("v0"))
    c = current.select("check_id", F.col("status").alias("s1"), F.col("severity").alias("v1"))
    kind = (
        F.when(F.col("s0").isNull(), "added")
        .when(F.col("s1").isNull(), "removed")
        .when((F.col("s0") == "passed") & (F.col("s1") == "failed"), "regressed")
        .when((F.col("s0") == "failed") & (F.col("s1") == "passed"), "improved")
        .when((F.col("s0") == F.col("s1")) & F.col("v0").eqNullSafe(F.col("v1")), "unchanged")
        .otherwise("changed")
    )
    return b.join(c, "check_id", "full_outer").withColumn("transition", kind).select("check_id", F.col("s0").alias("baseline_status"), F.col("s1").alias("current_status"), "transition")
