"""Accepted exceptions: an allowlist that is joined to all differences, not to a sample of them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "entry int, check_id string, ref_kind string, ref array<string>, field string, reason_code string, reason string, owner string, reference string, expires date"


def entries_frame(spark: SparkSession, entries: Sequence[dict]) -> DataFrame:
    """The entries of an exception file as rows. Keys and groups are arrays of strings."""
    rows = []
    for i, e in enumerate(entries):
        kind = "key" if "key" in e else "group"
        ref = e[kind] if isinstance(e[kind], list) else [e[kind]]
        expires = e.get("expires")
        expires = date.fromisoformat(str(expires)) if expires is not None else None
        rows.append((i, e["check"], kind, [str(x) for x in ref], e.get("field"), e["reason_code"], e["reason"], e.get("owner"), e.get("reference"), expires))
    return spark.createDataFrame(rows, ENTRY)


def matched(differences: DataFrame, entries: DataFrame, today: date) -> DataFrame:
    """``differences`` (check_id, ref_kind, ref, source_field, target_field) with ``entry``, null where none that is in force matches.

    G2: an entry is out of force from the day after ``expires``. A difference that several entries match has a
    row for each; ``ambiguous`` finds them.
    """
    live = entries.where(F.col("expires").isNull() | (F.col("expires") >= F.lit(today)))
    e = live.select("entry", F.col("check_id").alias("e_check"), F.col("ref_kind").alias("e_kind"), F.col("ref").alias("e_ref"), F.col("field").alias("e_field"))
    same = (F.col("check_id") == F.col("e_check")) & (F.col("ref_kind") == F.col("e_kind")) & (F.col("ref") == F.col("e_ref"))
    field = F.col("e_field").isNull() | F.coalesce(F.col("e_field") == F.col("source_field"), F.lit(False)) | F.coalesce(F.col("e_field") == F.col("target_field"), F.lit(False))
    return differences.join(e, same & field, "left").drop("e_check", "e_kind", "e_ref", "e_field")


def ambiguous(found: DataFrame, key: Sequence[str] = ("check_id", "ref_kind", "ref", "kind")) -> DataFrame:
    """Differences that more than one entry matches."""
    return found.where("entry is not null").groupBy(*key).agg(F.count_distinct("entry").alias("entries")).where("entries > 1")


def net(found: DataFrame) -> DataFrame:
    """G1: gross_failures, accepted_exceptions and unaccepted_failures of each check."""
    by = found.groupBy("check_id").agg(F.count(F.lit(1)).alias("gross_failures"), F.count("entry").alias("accepted_exceptions"))
    return by.withColumn("unaccepted_failures", F.col("gross_failures") - F.col("accepted_exceptions"))


def standing(entries: DataFrame, found: DataFrame, today: date) -> DataFrame:
    """``entries`` with ``status``: used, unused or expired."""
    used = found.where("entry is not null").select(F.col("entry").alias("u")).distinct()
    out = entries.join(used, F.col("entry") == F.col("u"), "left")
    return out.withColumn("status", F.when(F.col("expires") < F.lit(today), "expired").when(F.col("u").isNotNull(), "used").otherwise("unused")).drop("u")
