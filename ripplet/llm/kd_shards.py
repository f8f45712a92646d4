"""K-d tree sharding: nodes are split at weighted medians along their widest metadata dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import gapless_rank, written

#: A point's key on a dimension: this many bits of the coordinate, then a hash of the row for rows with one coordinate.
COORDINATE, TIE, STEP = 24, 24, 12


def kd_leaves(points: DataFrame, dims: list[str], size: str, row: list[str], leaves: int, name: str = "leaf") -> DataFrame:
    """Adds the leaf (0 .. leaves - 1) of a k-d tree; leaves get near equal sums of `size`.

    Each level takes two kinds of aggregates over the points, both of a few rows a node: the extent of every dimension
    (the widest is split; dims are numbers, null counts as the least), and histograms of the key that find the
    weighted median, each 4096 times as fine as the one before. Rows that share a coordinate are told apart by a hash of
    `row`, so that a hot value is split too; rows equal in `row` stay together. `points` is read about six times a
    level: a written table with no text is best.
    """
    extent = points.agg(*[F.min(d).alias(f"lo{i}") for i, d in enumerate(dims)], *[F.max(d).alias(f"hi{i}") for i, d in enumerate(dims)]).first()
    scaled = []
    for i, d in enumerate(dims):
        lo, hi = extent[f"lo{i}"], extent[f"hi{i}"]
        wide = float(hi - lo) if lo is not None and hi > lo else 1.0
        scaled.append(F.coalesce(((F.col(d) - F.lit(float(lo or 0))) / F.lit(wide) * (2**COORDINATE - 2) + 1).cast("long"), F.lit(0)).alias(f"__d{i}"))
    tie = F.pmod(F.xxhash64(*row), F.lit(2**TIE)).alias("__tie")
    now = points.select("*", *scaled, tie, F.lit(0).alias("__node"))
    parts = {0: leaves}  # node -> leaves under it; a node's first leaf is its number
    while any(k > 1 for k in parts.values()):
        found = now.groupBy("__node").agg(*[F.max(f"__d{i}").alias(f"hi{i}") for i in range(len(dims))], *[F.min(f"__d{i}").alias(f"lo{i}") for i in range(len(dims))], F.sum(size).alias("size"))
        split: dict[int, list[float]] = {}  # node -> dimension, what the left side is to hold, least key of the right side
        for r in found.collect():  # at most `leaves` rows
            if parts[r["__node"]] > 1:
                widest = max(range(len(dims)), key=lambda i: r[f"hi{i}"] - r[f"lo{i}"])
                k = parts[r["__node"]]
                split[r["__node"]] = [widest, (r["size"] or 0) * (k // 2) / k, 0]
        if not split:
            break
        key = _of(split, lambda node: F.col(f"__d{split[node][0]}")) * 2**TIE + F.col("__tie")
        keyed = now.withColumn("__key", key)
        for shift in range(COORDINATE + TIE - STEP, -1, -STEP):
            base = _of(split, lambda node: F.lit(int(split[node][2])))
            bin_ = F.shiftright(F.col("__key") - base, shift)
            inside = keyed.where(F.col("__node").isin(list(split))).withColumn("__bin", bin_).where((F.col("__key") >= base) & (F.col("__bin") < 2**STEP))
            bars: dict[int, list[tuple[int, int]]] = {}
            for r in inside.groupBy("__node", "__bin").agg(F.sum(size).alias("size")).collect():  # at most 4096 rows a node
                bars.setdefault(r["__node"], []).append((r["__bin"], r["size"] or 0))
            for node, found in bars.items():
                for at, weight in sorted(found):
                    if split[node][1] < weight or at == max(found)[0]:
                        split[node][2] += at << shift
                        break
                    split[node][1] -= weight
        right = _of(split, lambda node: (F.col("__key") >= F.lit(int(split[node][2]))).cast("int") * (parts[node] // 2))
        now = written(keyed.withColumn("__node", F.col("__node") + F.coalesce(right, F.lit(0))).drop("__key"), "kd-level")
        for node in split:
            parts[node + parts[node] // 2] = parts[node] - parts[node] // 2
            parts[node] //= 2
    return now.withColumnRenamed("__node", name).drop("__tie", *[f"__d{i}" for i in range(len(dims))])


def _of(nodes: dict, make) -> Column:
    """The expression made for a row's node."""
    out = None
    for node in nodes:
        out = (F if out is None else out).when(F.col("__node") == node, make(node))
    return out


def shards(docs: DataFrame, n_shards: int | None = 24, target_bytes: int | None = None) -> DataFrame:
    """Puts every document into a shard: the k-d tree's law is `bytes`, sizes near equal.

    Size: the text's UTF-8 bytes plus 8, 8 for a null text. The dimensions are lang, source (both by crc32, so that equal
    values lie together), and the logarithm of n_chars; nulls count as the least. Returns doc_id, size, text_crc32
    (null text: that of an empty one), law, shard, slot (0, 1, ... in the shard) and grown_shard (null: only the `key`
    law has it). Rows that are equal in all of these are parted like others. With target_bytes instead of n_shards, there are as many shards as it takes. Empty input: no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.coalesce(F.col("n_chars"), F.lit(0))
    crc = lambda c: F.crc32(c.cast("binary"))
    points = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        crc(text).alias("text_crc32"),
        *[crc(F.col(c)).cast("double").alias(c) for c in ("lang", "source")],
        F.log1p(F.greatest(plain, F.lit(0)).cast("double")).alias("long"),
        F.monotonically_increasing_id().alias("row"),  # parts rows that are equal in everything else
    )
    points = written(points, "points")
    if n_shards is None:
        n_shards = max(1, math.ceil((points.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    leaves = written(kd_leaves(points, ["lang", "source", "long"], "size", ["doc_id", "text_crc32", "row"], n_shards, "shard").select("doc_id", "size", "text_crc32", "shard"), "leaves")
    ranked = gapless_rank(leaves, ["shard"], ["doc_id", "text_crc32"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
