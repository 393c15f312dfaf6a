"""Reconciliation of a stream against a table, one micro-batch at a time.

An extension of ours: of the rows of a micro-batch that share a key the latest one is compared with the target.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.checks import mismatches
from ..operators.keyed import Keyed, keyed


def latest(side: Keyed, order: str) -> Keyed:
    """One row a key, that with the greatest ``order``; rows without one come first."""
    place = F.row_number().over(W.partitionBy(*side.keys).orderBy(F.col(order).desc_nulls_last(), F.col("__ord").desc()))
    return Keyed(side.rows.withColumn("__place", place).where("__place = 1").drop("__place"), side.width, side.side, side.flags)


def reconcile_stream(stream: DataFrame, target: Callable[[], DataFrame], key: str | list[str], target_key: str | list[str], check: Mapping, sink: Callable[[DataFrame, int], None], checkpoint: str, order: str) -> StreamingQuery:
    """Starts a query that hands the mismatches of each micro-batch to ``sink``. ``target`` is read anew for every batch.

    order: the column that tells which of a key's rows is the latest.
    """

    def batch(rows: DataFrame, number: int) -> None:
        sink(mismatches(latest(keyed(rows, key), order), keyed(target(), target_key, side="target"), check), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
