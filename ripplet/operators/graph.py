"""Graph building and traversal over edge and node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.sources.scratch import written

#: Edge types that a change doesn't travel along.
STRUCTURAL = ("CONTAINS", "EXPORTS")


def confidence_rank(c: Column) -> Column:
    return F.when(c == "HIGH", 3).when(c == "MEDIUM", 2).otherwise(1)


def confidence_of(rank: Column) -> Column:
    return F.when(rank == 3, "HIGH").when(rank == 2, "MEDIUM").otherwise("LOW")


def edge_id() -> Column:
    return F.concat("src", F.lit("->"), "dst", F.lit(":"), "type")


def dedupe_edges(edges: DataFrame, dealt: bool = False) -> DataFrame:
    """One edge for each (src, dst, type): the first place, the best confidence, the first evidence there is. Few edges repeat, so
    they are dealt out before they are grouped (a task's own groups would be as many as its rows), and by their ends alone,
    so that live_pairs() finds them together; not again if the caller has dealt them by src."""
    best = F.max(confidence_rank(F.col("confidence")))
    evidence = F.min_by("evidence", F.when(F.col("evidence").isNotNull(), F.col("seq")))
    grouped = (edges if dealt else edges.repartition("src", "dst")).groupBy("src", "dst", "type").agg(F.min("seq").alias("seq"), best.alias("rank"), evidence.alias("evidence"))
    return grouped.select(edge_id().alias("id"), "src", "dst", "type", confidence_of(F.col("rank")).alias("confidence"), "evidence", "seq")


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """The first node of each id."""
    rest = [c for c in nodes.columns if c not in ("id", "seq")]
    first = nodes.groupBy("id").agg(F.min_by(F.struct(*rest), "seq").alias("n"), F.min("seq").alias("seq"))
    return first.select("id", *[F.col(f"n.{c}").alias(c) for c in rest], "seq")


def admit_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist and differ. Columns that can be made of the others (edge_id()) are better made afterwards."""
    ids = nodes.select("id")
    return edges.where("src <> dst").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(*edges.columns)


def pairs(edges: DataFrame, marks: tuple[str, ...] = (), typed: bool = False) -> DataFrame:
    """Parallel edges as one pair: the first place, the first edge's confidence, whether it is live (not purely structural), whether
    it has an edge of each type in marks (a column each) and, if typed, the first edge's type."""
    # Place and confidence in one number: aggregates of numbers need no sort.
    first = F.min(F.col("seq") * 4 + confidence_rank(F.col("confidence"))).alias("first")
    live = (F.max(F.when(F.col("type").isin(*STRUCTURAL), 0).otherwise(1)) == 1).alias("live")
    more = [F.max(F.col("type") == m).alias(m) for m in marks] + [F.min_by("type", "seq").alias("type")] * typed
    names = ["live", *marks, *["type"] * typed]
    grouped = edges.groupBy("src", "dst").agg(first, live, *more)
    return grouped.select("src", "dst", F.shiftright("first", 2).alias("pair_seq"), confidence_of(F.col("first") % 4).alias("confidence"), *names)


def live_pairs(edges: DataFrame) -> DataFrame:
    """pairs() without the purely structural ones."""
    return pairs(edges).where("live").drop("live")


def blast_radius(seeds: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """What depends on the seeds (id, rank), up to `depth` hops: id, depth, path from the seed, confidence.

    Breadth first: a node is found by the parent that comes first in its level, by the earliest pair. Each level is one
    join of the frontier with the pairs, an aggregate per node, and an anti join with what has been found. The pairs and
    each level are written once to the shared folder, so that no level is computed again by those after it.
    """
    return reached(seeds, written(live_pairs(edges), "pairs"), depth)


def reached(seeds: DataFrame, pairs: DataFrame, depth: int = 3) -> DataFrame:
    """blast_radius() over live pairs that are written already. If they have a type, so does each hop of a path: types."""
    typed = "type" in pairs.columns
    kinds = [F.array().cast("array<string>").alias("types")] * typed
    level = seeds.groupBy("id").agg(F.min("rank").alias("rank")).select("id", F.lit(0).alias("depth"), F.array("id").alias("path"), F.lit("HIGH").alias("confidence"), *kinds, F.array("rank").alias("order"))
    found = level
    for d in range(1, depth + 1):
        f, p = level.alias("f"), pairs.alias("p")
        # An order is the list of places on the way, so the least one is the first in breadth-first order.
        told = [F.array_append(F.expr("f.types"), F.expr("p.type")).alias("types")] * typed
        step = f.join(p, F.expr("f.id = p.dst")).select(F.expr("p.src").alias("id"), F.expr("f.path").alias("way"), F.expr("p.confidence").alias("confidence"), *told, F.array_append(F.expr("f.order"), F.expr("p.pair_seq")).alias("order"))
        best = step.groupBy("id").agg(F.min_by(F.struct("way", "confidence", *["types"] * typed), "order").alias("b"), F.min("order").alias("order"))
        new = best.join(found.select("id"), "id", "left_anti")
        path = F.array_append(F.col("b.way"), F.col("id")).alias("path")
        level = written(new.select("id", F.lit(d).alias("depth"), path, F.col("b.confidence").alias("confidence"), *["b.types"] * typed, "order"), "level")
        found = found.unionByName(level)
    return found


def related(node_ids: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges into and out of the given nodes (id), with the node at the other end. Edges are read once: each row is told to both ends."""
    ends = nodes.select(F.col("id").alias("other"), F.col("type").alias("other_type"), F.col("name").alias("other_name"))
    end = lambda at, direction, other: F.struct(F.col(at).alias("id"), F.lit(direction).alias("direction"), F.col(other).alias("other"))
    both = edges.select(F.explode(F.array(end("dst", "in", "src"), end("src", "out", "dst"))).alias("e"), "type", "confidence").select("e.*", "type", "confidence")
    return both.join(node_ids, "id").select("id", "direction", "other", "type", "confidence").join(ends, "other")


def search(nodes: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """The first nodes whose name, file or id holds the query, whatever the case."""
    held = [F.contains(F.lower(F.col(c)), F.lit(query.lower())) for c in ("name", "file", "id")]
    return nodes.where(held[0] | held[1] | held[2]).orderBy("seq").limit(limit)


def unique_names(nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Names that just one node of the types has, with its id."""
    return nodes.where(F.col("type").isin(*types)).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("name", "id")


def chain(starts: DataFrame, edges: DataFrame, hops: int = 4, types: tuple[str, ...] = ("CALLS", "DEPENDS_ON", "USES")) -> DataFrame:
    """From each start (id), the first edge of the types again and again: hop, node; a way ends before a node it has."""
    first = edges.where(F.col("type").isin(*types)).groupBy("src").agg(F.min_by("dst", "seq").alias("next"))
    now = starts.select(F.col("id").alias("start"), F.array("id").alias("way"))
    for _ in range(hops):
        n = now.join(first, F.element_at("way", -1) == F.col("src"), "left")
        go = F.col("next").isNotNull() & ~F.array_contains("way", F.col("next"))
        now = n.select("start", F.when(go, F.array_append("way", F.col("next"))).otherwise(F.col("way")).alias("way"))
    return now.select("start", F.posexplode("way").alias("hop", "node"))


def type_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def confidence_mix(edges: DataFrame) -> DataFrame:
    """Counts and whole percents of each confidence; percents are null without edges."""
    n = F.count("*")
    counts = {c: F.count_if(F.col("confidence") == c) for c in ("HIGH", "MEDIUM", "LOW")}
    percent = {c: F.when(n > 0, F.floor(100.0 * k / n + 0.5).cast("long")) for c, k in counts.items()}
    return edges.agg(n.alias("n"), *[k.alias(c.lower()) for c, k in counts.items()], *[p.alias(c.lower() + "_pct") for c, p in percent.items()])


def overview(nodes: DataFrame, edges: DataFrame, node_types: tuple[str, ...], edge_types: tuple[str, ...], most_nodes: int = 400, most_edges: int = 800) -> DataFrame:
    """The edges among the first nodes of the types."""
    shown = nodes.where(F.col("type").isin(*node_types)).orderBy("seq").limit(most_nodes).select("id")
    held = edges.where(F.col("type").isin(*edge_types)).join(shown.withColumnRenamed("id", "src"), "src", "left_semi").join(shown.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return held.orderBy("seq").limit(most_edges)


def infra_chain(kinds: DataFrame) -> DataFrame:
    """DEPLOYS edges between kinds (kind, rank) that follow each other in the fixed order."""
    w = Window.orderBy("rank")  # a handful of kinds
    return kinds.select(F.col("kind").alias("src"), F.lead("kind").over(w).alias("dst")).where("dst is not null").select("src", "dst", F.concat(F.lit("DEPLOYS:"), "src", F.lit(":"), "dst").alias("id"), F.lit("LOW").alias("confidence"))
