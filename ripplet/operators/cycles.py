"""Cycles of a directed graph: strongly connected components, and the least cycle of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.sources.scratch import discard, written

#: How joins are done whose sides come round by round: a broadcast would pass through the driver in each.
MERGE = "merge"


def _trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """The edges without nodes that nothing leads to, or that lead nowhere: these are in no cycle. A few rounds take off most of
    a graph; what long chains are left costs colours, and no result."""
    for _ in range(rounds):
        heads, tails = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        left = written(edges.join(heads.hint(MERGE), "dst", "left_semi").join(tails.hint(MERGE), "src", "left_semi").select("src", "dst"), "trimmed")
        before, after = edges.count(), left.count()
        discard(edges)
        edges = left
        if before == after:
            break
    return edges


def _coloured(edges: DataFrame, steps: int = 3) -> DataFrame:
    """(node, colour) of each node on edges (src, dst): the greatest node from which it can be reached, itself included.

    In a step a node takes the greatest colour of itself, of the nodes that lead to it, and of its colour: the last makes ways
    of several steps one, so that there are fewer steps than the longest way has. A few steps are written at once. A hub's
    rows are added up before they are shuffled, and its join is left to AQE, which splits it.
    """
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    now = written(ends.select("node", F.col("node").alias("colour")), "colours")
    while True:
        next_ = now.select("node", "colour")
        for _ in range(steps):
            led = edges.join(next_.withColumnRenamed("node", "src").hint(MERGE), "src").select(F.col("dst").alias("node"), "colour")
            far = next_.withColumnRenamed("colour", "at").join(next_.withColumnRenamed("node", "at").hint(MERGE), "at").select("node", "colour")
            next_ = next_.unionByName(led).unionByName(far).groupBy("node").agg(F.max("colour").alias("colour"))
        moved = next_.join(now.select("node", F.col("colour").alias("old")).hint(MERGE), "node").select("node", "colour", (F.col("colour") > F.col("old")).alias("moved"))
        after = written(moved, "colours")
        discard(now)
        now = after
        if not now.where("moved").limit(1).count():
            return now.select("node", "colour")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles of edges (src, dst): component is the least node of the strongly connected
    component. Nodes on no cycle, and those that only lead to themselves, aren't in it. Repeated edges count once; edges with
    a null end are dropped; no edges give no rows.

    Nodes are coloured by the greatest node that leads to them; a component has one colour, so edges between colours go. Then
    they are coloured the other way: those that lead to the node whose colour they have are its component. They go, and
    the rest begins again, until no edges are left. No loop goes over nodes, and each table is written once.
    """
    ends = edges.where("src is not null and dst is not null and src <> dst")
    left, done = _trimmed(written(ends.select("src", "dst").distinct(), "edges")), None
    while left.limit(1).count():
        colours = _coloured(left)
        one, two = colours.toDF("src", "from_colour"), colours.toDF("dst", "to_colour")
        inner = written(left.join(one.hint(MERGE), "src").join(two.hint(MERGE), "dst").where("from_colour = to_colour").select("src", "dst"), "inner")
        back = _coloured(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("colour", "reached")
        held = written(colours.join(back.hint(MERGE), "node").where("colour = reached").select("node", "colour"), "held")
        done = held if done is None else done.unionByName(held)
        gone = held.select("node")
        rest = inner.join(gone.withColumnRenamed("node", "src").hint(MERGE), "src", "left_anti").join(gone.withColumnRenamed("node", "dst").hint(MERGE), "dst", "left_anti")
        after = written(rest.select("src", "dst"), "edges")
        discard(left, colours, inner, back)
        left = _trimmed(after)
    if done is None:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    named = done.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    return done.join(named.hint(MERGE), "colour").select("node", "component")


def least_cycles(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, size, cycle) of the components (node, component) of edges: the shortest cycle through a component's least
    node, as the list of its nodes from that node back to it; among equally short ones the least list.

    All components are searched at once, breadth first from their least nodes along their own edges; a node keeps the least
    way to it, and a component ends when a way comes back.
    """
    inside = edges.where("src <> dst").select("src", "dst").distinct().join(parts.toDF("src", "component").hint(MERGE), "src").join(parts.toDF("dst", "other").hint(MERGE), "dst")
    own = written(inside.where("component = other").select("component", "src", "dst"), "own")
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    now = written(sizes.select("component", F.col("component").alias("node"), F.array("component").alias("way")), "ways")
    seen, found, tables = now.select("component", "node"), None, [now]
    while now.limit(1).count():
        step = now.join(own.withColumnRenamed("src", "node").hint(MERGE), ["component", "node"]).select("component", F.col("dst").alias("node"), F.array_append("way", F.col("dst")).alias("way"))
        best = written(step.groupBy("component", "node").agg(F.min("way").alias("way")), "ways")
        ends = best.where("node = component").select("component", "way")
        found = ends if found is None else found.unionByName(ends)
        now = written(best.join(ends.hint(MERGE), "component", "left_anti").join(seen.hint(MERGE), ["component", "node"], "left_anti"), "ways")
        seen = seen.unionByName(now.select("component", "node"))
        tables += [best, now]
    none = now.select("component", "way")
    done = written(sizes.join((none if found is None else found).hint(MERGE), "component").select("component", "size", F.col("way").alias("cycle")), "cycles")
    discard(own, *tables)
    return done


def circular_dependencies(imports: DataFrame) -> DataFrame:
    """A finding for each group of files that import each other in a circle: the imports (src, dst) are ids FILE:<path>.

    rule, category, severity, title, message, file, evidence, confidence; size is the number of files in the group. A group
    has one finding, its least cycle, whatever the order of files and imports.
    """
    files = imports.where("startswith(src, 'FILE:') and startswith(dst, 'FILE:')").select("src", "dst")
    found = least_cycles(files, written(components(files), "components"))
    shown = F.array_join(F.transform("cycle", lambda x: F.substr(x, F.lit(6))), " → ")
    fixed = {"rule": "circular_dependency", "category": "quality", "severity": "high", "title": "Circular dependency detected", "confidence": "HIGH"}
    return found.select(
        *[F.lit(v).alias(k) for k, v in fixed.items()],
        F.concat(F.lit("Import cycle: "), shown).alias("message"),
        F.substr("component", F.lit(6)).alias("file"),
        F.array_join("cycle", " → ").alias("evidence"),
        "size",
    )
