"""Connected components by alternating large-star and small-star steps, all on distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest of a node's neighbourhood: larger neighbours (large) or the others (small)."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # each edge stands at its larger end
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root hangs on another."""
    total, nodes = edges.agg(F.count("*"), F.count_distinct("a")).first()
    if total != nodes:
        return False
    return edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of the edges (a, b); component is the smallest id that can be reached."""
    now = edges.filter("a <> b")
    for _ in range(max_rounds):
        now = written(_star(_star(now, True), False), "edges")
        if _settled(now):
            break
    else:
        raise RuntimeError("components did not settle")
    pairs = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return pairs.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
