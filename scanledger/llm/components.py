"""Connected components of a graph given as edges, by rounds of joins and aggregates.

Two steps alternate until nothing changes: every node hands the smallest node it knows to its larger neighbours, then to its smaller ones.
The number of rounds grows with the logarithm of the longest path. Minima are combined before they are shuffled, so
a node with very many edges costs one row per task there. Each round is written to the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scanledger.staging import staged


def _hand_on(edges: DataFrame, larger: bool) -> DataFrame:
    high, low = F.greatest("u", "v"), F.least("u", "v")
    seen = edges.select(high.alias("u"), low.alias("v"))
    if larger:
        seen = seen.unionByName(edges.select(low.alias("u"), high.alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    told = (seen.filter("v > u") if larger else seen).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        told = told.unionByName(least.select("u", F.col("m").alias("v")))
    return told.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v) that is not the smallest of its component, which is its root."""
    edges = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        edges = staged(_hand_on(_hand_on(edges, True), False))
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
