"""Chains of stages: where a difference first appears."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_divergence(edges: list[tuple[str, DataFrame]], locator: list[str]) -> DataFrame:
    """For each locator the first transition that shows it, and how many transitions do.

    edges: (transition, differences) in the order of the chain. One aggregation over the union; nothing is
    sorted or gathered by locator.
    """
    parts = [d.select(*locator, F.lit(i).alias("step"), F.lit(name).alias("transition")) for i, (name, d) in enumerate(edges)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    names = F.array(*[F.lit(n) for n, _ in edges])
    by = every.groupBy(*locator).agg(F.min("step").alias("step"), F.count_distinct("step").alias("transitions"))
    return by.select(*locator, F.get(names, F.col("step")).alias("first_transition"), F.col("step").alias("transition_index"), "transitions")
