"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import staged


def star(links: DataFrame, large: bool) -> DataFrame:
    """Each node hands its neighbours (the larger ones, or the smaller ones and itself) its smallest neighbour.

    The smallest neighbour is found with partial aggregation and joined back, so that a node with very
    many neighbours is not gathered in one task.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), F.least("u", "m").alias("m"))
    near = both.join(least, F.col("u") == F.col("u_"))
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("u_").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); root is the smallest node of the component.

    Nulls are no nodes. Loops and repeated links are allowed. Without links there are no rows.
    """
    links = staged(links.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "links")
    before = None
    while True:
        links = staged(star(star(links, True), False), "stars")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
