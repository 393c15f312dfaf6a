"""A training corpus from raw documents, in stages that each call one operator of ``tessella.llm``.

Rows: null texts and null metadata are rows like others until a stage's rule drops them; a null doc_id is kept unless
quality rules or decontamination reject its text. Repeated rows are judged one by one but count as one document among
near duplicates, where rows that share a doc_id stay together. Ties are broken by values, never by place. Columns
that no operator knows are carried through, whatever their names. An empty table passes all stages as an empty table.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontam, group_join, mixing, quality, sharding
from tessella.llm.tables import discard, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Null and empty texts go; repeated rows are all kept or all rejected."""
    return quality.kept_rows(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id. A null doc_id stays."""
    return group_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the benchmark does not contaminate. Null texts have no words and stay."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those without words are taken not at all. Null sources are one source."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows that are left, with their shard and their slot in it. Each repetition is a row of its own."""
    return sharding.sharded(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: The mix is decided by folds over hashed blocks and the shards by repeated splits, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input.

    A stage's folder goes as soon as the next stage is written; the last one is the result.
    """
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        out = posixpath.join(at, str(k))
        stage(spark, docs, sf_dir).write.parquet(out)
        if before is not None:
            discard(before)
        docs = before = spark.read.parquet(out)
    return docs
