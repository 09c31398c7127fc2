"""Connected components of a table of links, in rounds of joins that halve the distance to the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import saved


def _towards_least(edges: DataFrame, upward: bool) -> DataFrame:
    """Each node hands its neighbours the least id it knows: to the larger ones (upward) or to the smaller ones."""
    if upward:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(
            least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node it reaches) for every node of the links (columns a, b)."""
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = saved(_towards_least(_towards_least(edges, True), False))
    smaller = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(smaller).distinct()
