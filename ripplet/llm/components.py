"""Connected components by DataFrame joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node links its larger neighbours to the least of its neighbours and itself; else its smaller ones."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node on an edge (a, b) of any direction; component is the least node reachable.

    Each step is two joins over the edges, partial aggregates before each shuffle; a hot node's rows are left to AQE's
    skew join. Steps double the reach, so their number grows with the logarithm of the longest chain. Null ends and
    loops are dropped. No edges: no rows.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    now = written(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        before, now = now, written(_star(_star(now, True), False), name)
        discard(before)
        heads = now.select(F.col("v").alias("u")).distinct()
        again = now.join(heads, "u", "left_semi").limit(1).count()
        parents = now.groupBy("u").count().where("count > 1").limit(1).count()
        if not again and not parents:
            break
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
