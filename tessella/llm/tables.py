"""Written tables in the cluster's shared folder, and guards on what is broadcast."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words (fixed values of the contract).
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a fresh one only where it is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    The lineage is cut, so a lost executor costs a reread and not a recomputation. What the table was made
    of is no longer needed then: a collection of garbage on the driver lets Spark delete the shuffle files
    of plans that nobody holds any more. The table's files go when the driver's file system is closed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _files(spark, path)
    files.deleteOnExit(place)
    schema = df.schema
    del df
    freed(spark)
    return spark.read.schema(schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Collects the driver's garbage, so that Spark deletes the shuffle files of plans that nobody holds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(table: DataFrame) -> None:
    """Deletes a staged table that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        place, files = _files(table.sparkSession, path)
        files.delete(place, True)


def sent_if_small(table: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """A staged table of a few narrow columns, to be broadcast if it has no more than ``rows`` rows; else it is dealt out."""
    return F.broadcast(table) if table.count() <= rows else table


def empty_safe_text(docs: DataFrame) -> Column:
    """The text column with null read as the empty string."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per row of ``df`` with ``keys`` and ``copy``: 0, 1, ... among rows that agree in all keys.

    Counted before they are dealt out and then expanded, so that a row repeated any number of times
    never meets its copies in one window.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
        .drop("__n")
    )


def uniform(*cols: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends only on the values and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, so that very long texts don't meet by the thousand in one batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
