"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandlab.llm.shared import forget, written


def _stored(edges: DataFrame, tag: str) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and a sum over them, which are taken while they are written."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")), tag)
    return out, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and component (the smallest node of its component) for each node of edges(u, v); loops may be among them.

    Each round links every node to its smallest neighbour, so paths halve; a hub's many edges are only joined with
    the hub's minimum, which Spark can split. If the graph hasn't settled after most_rounds, it is an error.
    """
    now, state = _stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large, "large")  # an edge gives one edge at most, so equal ones wait for the other star
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        earlier, before = now, state
        now, state = _stored(small.filter("u <> v").distinct(), "small")
        forget(earlier, large)
        if state == before:
            break
    else:
        raise RuntimeError(f"components haven't settled after {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
