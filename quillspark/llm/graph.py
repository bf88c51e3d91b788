"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize


def _step(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u, v), u > v."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v"), "large-star")
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.withColumnRenamed("m", "v"))
    out = materialize(small.distinct(), "small-star")
    discard(large)
    return out


def contract(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges (a, b), a > b, with the same components after one step: most nodes point to the least they can reach."""
    return _step(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")).toDF("a", "b")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node that has an edge, with the smallest node it can reach.

    Every step is a grouped minimum (combined before its shuffle) joined back to the edges. A hub's edges meet its one
    minimum in that join, which streams them; adaptive execution splits them over tasks where they are skewed. Null ends
    and loops are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    e, seen = materialize(e, "edges"), None
    for _ in range(max_rounds):
        old, e = e, _step(e)
        discard(old)
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
