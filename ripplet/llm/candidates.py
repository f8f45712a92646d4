"""Pairs to compare among the members of hash buckets, without all pairs of a large bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import discard, written

def shared(banded: DataFrame, name: str) -> DataFrame:
    """(bucket, node, least) of rows (bucket, node) whose bucket has other nodes too; least is its least node."""
    least = banded.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    return written(banded.join(least.select("bucket", "least"), "bucket").distinct(), name)


def star(members: DataFrame) -> DataFrame:
    """Each node with the least of its bucket: (a, b)."""
    return members.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def across(
    members: DataFrame, groups: DataFrame, name: str, known: Callable[[DataFrame], DataFrame], fits: Callable[[str, str], Column], sums: tuple[str, ...] = ()
) -> DataFrame:
    """The pairs (a, b) of different components (node, component) that share a bucket and can be alike.

    known() gets the rows (bucket, node, component, size) of buckets with several components and adds columns, or leaves out
    rows that can't be in a pair; fits(x, y) asks these columns, with the suffixes x and y, whether a pair can be alike. A
    pair is made in the first of its shared buckets only. Of the columns sums a pair gets the sum of both sides.
    """
    found = members.join(groups.select("node", "component"), "node", "left")
    named = found.select("bucket", "node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
    mixed = written(named.join(sizes.where("lo < hi").select("bucket", "size"), "bucket"), f"{name}-mixed")
    full = known(mixed)
    # As many buckets as there are bands at most.
    full = full.join(mixed.groupBy("node").agg(F.array_sort(F.collect_set("bucket")).alias("own")), "node")
    rest = [c for c in full.columns if c not in ("bucket", "size")]
    x, y = (full.select("bucket", *[F.col(c).alias(c + end) for c in rest]) for end in ("_x", "_y"))
    first = F.col("bucket") == F.array_min(F.array_intersect("own_x", "own_y"))
    on = (F.col("node_x") > F.col("node_y")) & (F.col("component_x") != F.col("component_y")) & fits("_x", "_y") & first
    both = [(F.col(c + "_x") + F.col(c + "_y")).alias(c) for c in sums]
    pairs = written(x.join(y, "bucket").where(on).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"), *both), f"{name}-across")
    discard(mixed)
    return pairs


def bounded(
    mixed: DataFrame, shingles: Callable[[DataFrame], DataFrame], percent: int, small: int, name: str, peels: int = 2
) -> DataFrame:
    """For across(): rows of buckets of more than `small` members get n, the size of a node's set, and m, how many of its
    shingles others of these nodes have too; shingles() gives (node, gram) of nodes, their whole sets. A set's similarities
    are at most m / n: nodes that can't reach percent go, without loss, and then their shingles count no more. Rows of
    smaller buckets get n = m = 1, which holds nothing back."""
    large, one = mixed.where(F.col("size") > small), F.lit(1).cast("long")
    held = mixed.where(F.col("size") <= small).withColumns({"n": one, "m": one})
    if not large.limit(1).count():
        return held
    grams = written(shingles(large.select("node").distinct()), f"{name}-grams")
    whole = written(grams.groupBy("node").agg(F.count("*").alias("n")), f"{name}-sizes")
    for _ in range(peels):
        again = grams.groupBy("gram").count().where("count > 1").select("gram")
        common = grams.join(again, "gram").groupBy("node").agg(F.count("*").alias("m"))
        able = written(whole.join(common, "node").where(100 * F.col("m") >= percent * F.col("n")), f"{name}-able")
        before, grams = grams, written(grams.join(able.select("node"), "node", "left_semi"), f"{name}-grams")
        discard(before)
    discard(grams)
    return held.unionByName(large.join(able, "node"))


def reach(x: str, y: str, percent: int) -> Column:
    """Whether two sets can be alike: they share at most the lesser m."""
    return (100 + percent) * F.least("m" + x, "m" + y) >= percent * (F.col("n" + x) + F.col("n" + y))
