"""Profiles of datasets: one aggregation for all columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import columns_of
from ..functions.values import is_blank, moment, strip

#: What names of business keys look like without case and separators, best first, and their score.
KEY_NAMES = ((r"^id$", 1.0), (r"id$|key", 0.9), (r"(code|number|no)$", 0.7), ("", 0.2))
TYPES = ("boolean", "integer", "number", "datetime", "string")


def value_type(c: Column) -> Column:
    """what a cell that is not blank looks like."""
    s = strip(c)
    plain = F.regexp_replace(s, ",", "")
    return (
        F.when(F.lower(s).isin("true", "false"), "boolean")
        .when(plain.rlike(r"\A[+-]?[0-9]+\z"), "integer")
        .when(plain.try_cast("decimal(38,10)").isNotNull(), "number")
        .when(moment(c).isNotNull(), "datetime")
        .otherwise("string")
    )


def profiled(frame: DataFrame, approximate: bool = False) -> DataFrame:
    """Field, rows, nulls, null_rate, distinct, uniqueness and inferred_type of each column, as one row a column.

    Cells are counted by column and value, and each different value is looked at once. approximate: different values
    are counted with a sketch of bounded size, and no value is dealt out.
    """
    column = columns_of(frame, "dataset")
    names = frame.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in frame.columns])).alias("position", "field"))
    cells = frame.select(F.posexplode(F.array(*[F.when(~is_blank(column(n)), column(n).cast("string")) for n in frame.columns])).alias("at", "value"))
    filled = F.col("value").isNotNull()
    if approximate:
        cells = cells.withColumns({"c": F.lit(1), "kind": F.when(filled, value_type(F.col("value")))})
        distinct = F.approx_count_distinct("value")
    else:
        cells = cells.groupBy("at", "value").agg(F.count(F.lit(1)).alias("c")).withColumn("kind", F.when(filled, value_type(F.col("value"))))
        distinct = F.count_if(filled)
    kinds = [F.sum(F.when(F.col("kind") == t, F.col("c")).otherwise(0)).alias(t) for t in TYPES]
    by = cells.groupBy("at").agg(F.sum("c").alias("rows"), F.sum(F.when(filled, 0).otherwise(F.col("c"))).alias("nulls"), distinct.alias("distinct"), *kinds)
    by = names.join(by, F.col("position") == F.col("at"), "left").na.fill(0, ["rows", "nulls", "distinct", *TYPES])
    full = F.col("rows") - F.col("nulls")
    kind = F.when(F.col("rows") == 0, "empty").when(full == 0, "null")
    for t in TYPES:
        kind = kind.when(F.col(t) == full, t)
    kind = kind.when(F.col("integer") + F.col("number") == full, "number").otherwise("mixed")
    rate = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    return by.select("field", "position", "rows", "nulls", rate(F.col("nulls"), F.col("rows")).alias("null_rate"), "distinct", rate(F.col("distinct"), full).alias("uniqueness"), kind.alias("inferred_type"))


def plain_name(name: str) -> str:
    """names that are equal but for case and separators."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def key_score(name: str) -> float:
    """How much a column's name looks like a business key's."""
    return next(score for pattern, score in KEY_NAMES if re.search(pattern, plain_name(name)))


def candidate_keys(profile: DataFrame) -> DataFrame:
    """Field and score of columns that are never blank and always different, best first."""
    plain = F.regexp_replace(F.lower("field"), "[^a-z0-9]", "")
    score = F.coalesce(*[F.when(plain.rlike(pattern), F.lit(value)) for pattern, value in KEY_NAMES])
    unique = profile.where((F.col("rows") > 0) & (F.col("nulls") == 0) & (F.col("distinct") == F.col("rows")))
    return unique.select("field", score.alias("score")).orderBy(F.desc("score"), "field")
