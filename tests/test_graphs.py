"""Cycles, shortest ways, semantic diff and old sides against plain versions and hand-written cases."""

import difflib
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from ripplet.operators import cycles, expectations, graph, impact, semantic, shortest, sieve, tables
from ripplet.plans import catalog
from ripplet.sources.scratch import written

SIDE = "change long, path string, kind string, owner string, name string, parameters array<string>, return_type string, calls array<string>, body string, start_line int, end_line int"


def strong(edges):
    """Components of two nodes and more, by reachability of each node."""
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set())
    reach = {}
    for n in out:
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        reach[n] = seen
    return {n: min(m for m in out if m == n or (m in reach[n] and n in reach[m])) for n in out if n in reach[n]}


def least_cycle(edges, start):
    """The shortest way from start back to it, the least list among those."""
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
    level, seen = {start: [start]}, {start}
    while level:
        step = {}
        for n, way in level.items():
            for m in out.get(n, ()):
                if m == start or m not in seen:
                    step[m] = min(step.get(m, way + [m]), way + [m])
        if start in step:
            return step[start]
        seen |= set(step)
        level = step
    return None


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)]


GRAPHS = {
    "ring": [(f"r{i:02}", f"r{(i + 1) % 25:02}") for i in range(25)],
    "chain": [(f"c{i:02}", f"c{i + 1:02}") for i in range(25)],
    "figure-eight": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c")],
    "two rings and a bridge": [("a", "b"), ("b", "a"), ("b", "x"), ("x", "y"), ("y", "x"), ("q", "a"), ("a", "a"), ("s", "s")],
    "hub": [("h", f"l{i}") for i in range(40)] + [("l7", "h"), ("l7", "h"), ("l30", "z"), ("z", "h"), (None, "h"), ("h", None)],
    "random": random_edges(3, 40, 75),
    "dense": random_edges(4, 15, 60),
    "none": [],
}


def test_components_and_least_cycles(spark):
    """All graphs at once: none has to do with another."""
    edges = [tuple(x and f"{name}/{x}" for x in e) for name, some in GRAPHS.items() for e in some]
    table = spark.createDataFrame(edges, "src string, dst string")
    parts = written(cycles.components(table), "parts")
    found, whole = {r.node: r.component for r in parts.collect()}, [e for e in edges if None not in e]
    assert found == strong(whole)
    assert {x.partition("/")[0] for x in found} == set(GRAPHS) - {"chain", "none"}
    rows = cycles.least_cycles(table, parts).collect()
    assert {r.component: (r.size, r.cycle) for r in rows} == {c: (list(found.values()).count(c), least_cycle(whole, c)) for c in set(found.values())}
    assert cycles.components(table.limit(0)).collect() == []


def test_a_circular_dependency_is_one_finding(spark):
    table = spark.createDataFrame([("FILE:b.ts", "FILE:a.ts"), ("FILE:a.ts", "FILE:b.ts"), ("FILE:a.ts", "EXTERNAL:x"), ("EXTERNAL:x", "FILE:a.ts")], "src string, dst string")
    (row,) = cycles.circular_dependencies(table).collect()
    assert (row.file, row.message, row.evidence, row.size) == ("a.ts", "Import cycle: a.ts → b.ts → a.ts", "FILE:a.ts → FILE:b.ts → FILE:a.ts", 2)


def breadth_first(edges, a, b):
    """First found, neighbours in the order of edges."""
    near = {}
    for x, y in edges:
        near.setdefault(x, []).append(y)
        near.setdefault(y, []).append(x)
    if a == b:
        return [a]
    came, queue = {a: None}, deque([a] if a in near and b in near else [])
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in came:
                came[y] = x
                queue.append(y)
    if a is None or b not in came:
        return None
    way = [b]
    while came[way[-1]] is not None:
        way.append(came[way[-1]])
    return way[::-1]


def test_shortest_paths_are_those_of_a_plain_search(spark):
    rng = random.Random(8)
    edges = [*random_edges(6, 60, 75), *[(f"k{i}", f"k{i + 1}") for i in range(9)]]
    names = sorted({x for e in edges for x in e})
    picks = [(i, rng.choice(names), rng.choice(names)) for i in range(50)] + [(50, "k0", "k9"), (51, "k0", "n00"), (52, "k1", "k1"), (53, "no", "n00"), (54, None, "n00"), (55, "new", "new")]
    table = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src string, dst string, seq long")
    got = {r.pick: r.path for r in shortest.shortest_paths(spark.createDataFrame(picks, "pick long, a string, b string"), table).collect()}
    assert got == {i: breadth_first(edges, a, b) for i, a, b in picks}
    assert sum(p is not None and len(p) > 4 for p in got.values()) > 10 and len(got[50]) == 10


@pytest.mark.parametrize("hub", [0, 3])
def test_ways_through_hubs_are_those_of_a_plain_search(spark, hub):
    rng = random.Random(hub)
    names = [f"n{i:02}" for i in range(40)]
    edges = [(rng.choice(names[: 4 if i % 3 else 40]), rng.choice(names)) for i in range(70)] + [(f"k{i}", f"k{i + 1}") for i in range(9)] + [(f"k{i}", f"z{i}{j}") for i in (2, 3, 6, 7) for j in range(4)]
    picks = [(i, rng.choice(names), rng.choice(names)) for i in range(60)] + [(60, "k0", "k9"), (61, "k9", "k0"), (62, "k2", "k8"), (63, "z20", "z73"), (64, "k0", "n00"), (65, "z20", "z21")]
    table = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src string, dst string, seq long")
    got = {r.pick: r.path for r in shortest.shortest_paths(spark.createDataFrame(picks, "pick long, a string, b string"), table, hub).collect()}
    assert got == {i: breadth_first(edges, a, b) for i, a, b in picks}


def test_neighbours_of_a_hub_are_not_listed_for_each_pick(spark, monkeypatch):
    names, sizes = [f"l{i}" for i in range(300)], []
    edges = [(x, "hub") for x in names] + [("hub", "top"), ("top", "other")] + [(f"r{x}", "other") for x in names]
    picks = spark.createDataFrame([(i, x, f"r{x}") for i, x in enumerate(names)], "pick long, a string, b string")
    table = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src string, dst string, seq long")
    keep = shortest.written

    def counted(df, name):
        out = keep(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(shortest, "written", counted)
    got = {r.pick: r.path for r in shortest.shortest_paths(picks, table).collect()}
    few = max(sizes)
    sizes.clear()
    assert got == {i: [x, "hub", "top", "other", f"r{x}"] for i, x in enumerate(names)}
    assert {r.pick: r.path for r in shortest.shortest_paths(picks, table, 100).collect()} == got
    assert max(sizes) < 1500 < 90000 <= few


def test_edges_away_from_all_picks_are_neither_written_nor_dealt_out(spark, monkeypatch):
    edges = [("a", "x"), ("x", "y"), ("y", "b")] + [(f"p{i}", f"q{i}") for i in range(3000)]
    table = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src string, dst string, seq long")
    sizes, keep = [], shortest.written

    def counted(df, name):
        out = keep(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(shortest, "written", counted)
    picks = spark.createDataFrame([(0, "a", "b"), (1, "a", "q7")], "pick long, a string, b string")
    assert {r.pick: r.path for r in shortest.shortest_paths(picks, table).collect()} == {0: ["a", "x", "y", "b"], 1: None}
    assert max(sizes) < 10


@pytest.mark.parametrize("marks", [2**26, 64])
def test_a_sieve_holds_all_rows_of_its_keys(spark, monkeypatch, marks):
    monkeypatch.setattr(sieve, "MARKS", marks)
    rows = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("node"), (F.col("id") % 2).alias("kind"), "id")
    keys = rows.where("id % 100 = 0").select("node", "kind").unionByName(spark.createDataFrame([(None, 0)], "node string, kind long"))
    held = {r.id for r in sieve.sifted(rows, keys, "node", "kind").collect()}
    assert held >= set(range(0, 5000, 100)) and len(held) < (60 if marks > 64 else 5000)
    assert sieve.sifted(rows, keys.limit(0), "node").count() == 0


# Old sides


def test_old_sides_are_the_texts_before_random_edits(spark):
    rng, rows, expected = random.Random(1), [], {}
    for change in range(60):
        old = [rng.choice(["a", "b", "", "  x", "y"]) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        new = list(old)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(new) + 1)
            new[at : at + rng.randrange(3)] = ["new" + str(rng.random()) for _ in range(rng.randrange(3))]
        patch = "\n".join(difflib.unified_diff(old, new, "a", "b", lineterm=""))
        if new and patch:
            rows.append((change, "f.ts", patch, "\n".join(new)))
            expected[change] = "\n".join(old)
    got = {r.change: r.old_content for r in semantic.old_sides(spark.createDataFrame(rows, "change long, path string, patch string, content string")).collect()}
    assert got == expected and len(got) > 40


def test_old_sides_of_odd_patches(spark):
    cases = [
        ("deleted", "@@ -1,2 +0,0 @@\n-one\n-two", "", "one\ntwo"),
        ("deleted file with text left", "@@ -1,1 +0,0 @@\n-one", "still\nhere", "one"),
        ("context that isn't there", "@@ -2,2 +2,2 @@\n other\n-old\n+new", "a\nb\nc\nd", "a\nother\nold\nd"),
        ("beyond the end", "@@ -9,1 +9,1 @@\n-old\n+new", "a\nb", "a\nb\nold"),
        ("headers and notes", "diff --git a b\n--- a\n+++ b\n@@ -1,1 +1,1 @@\n-x\n+y\n\\ No newline at end of file", "y", "x"),
        ("no hunk", "just text", "a", None),
        ("null patch", None, "a", None),
        ("null text", "@@ -1,1 +1,0 @@\n-x", None, "x\n"),
        ("two hunks", "@@ -1,1 +1,2 @@\n+z\n a\n@@ -4,1 +5,0 @@\n-gone", "z\na\nb\nc\nd", "a\nb\nc\ngone\nd"),
    ]
    rows = [(i, "p", patch, text) for i, (_, patch, text, _) in enumerate(cases)]
    got = {r.change: r.old_content for r in semantic.old_sides(spark.createDataFrame(rows, "change long, path string, patch string, content string")).collect()}
    assert got == {i: old for i, (*_, old) in enumerate(cases)}


def test_old_sides_are_made_within_rows(spark):
    """Hunks that don't rise, meet or overlap, and nothing is dealt out."""
    cases = [
        ("@@ -4,1 +4,1 @@\n-D\n+d\n@@ -1,1 +1,1 @@\n-A\n+a", "a\nb\nc\nd", "A\nb\nc\nD"),
        ("@@ -1,1 +1,3 @@\n-A\n+a\n+b\n+c\n@@ -2,1 +2,1 @@\n-B\n+b", "a\nb\nc\nd", "A\nB\nd"),
        ("@@ -1,1 +2,0 @@\n-X\n@@ -1,1 +2,0 @@\n-Y", "a\nb", "a\nX\nY\nb"),
        ("@@ -1,1 +0,0 @@\n-X\n@@ -1,1 +0,0 @@\n-Y\n@@ -1,1 +1,1 @@\n-Z", "a\nb", "Y"),
        ("@@ -1,1 +1,1 @@\n+a", "a", ""),
    ]
    made = semantic.old_sides(spark.createDataFrame([(i, "p", p, t) for i, (p, t, _) in enumerate(cases)], "change long, path string, patch string, content string"))
    assert {r.change: r.old_content for r in made.collect()} == {i: old for i, (*_, old) in enumerate(cases)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


# Semantic diff


def side(spark, rows):
    return spark.createDataFrame([(1, "f.ts", *r, 1, 9) for r in rows], SIDE)


def test_each_kind_of_event(spark):
    f = lambda name, parameters=(), returns="void", calls=(), body="{}", kind="FUNCTION", owner=None: (kind, owner, name, list(parameters), returns, list(calls), body)
    old = [
        f("same", ["a:string"]),
        f("gone"),
        f("Gone", kind="CLASS"),
        f("gone", kind="METHOD", owner="C"),
        f("more", ["a:string"]),
        f("less", ["a:string", "b:number"]),
        f("order", ["a:string", "b:number"]),
        f("order_and_type", ["a:string", "b:number"], "void"),
        f("returns", returns="void"),
        f("calls", calls=["x", "y"]),
        f("body", body="{ 1 }"),
        f("Kept", body="class { 1 }", kind="CLASS"),
        (("METHOD", "C", "nulls", None, None, None, None)),
    ]
    new = [
        f("same", ["a:string"]),
        f("fresh"),
        f("Fresh", kind="CLASS"),
        f("fresh", kind="METHOD", owner="C"),
        f("more", ["a:string", "b:number"]),
        f("less", ["a:string"]),
        f("order", ["b:number", "a:string"]),
        f("order_and_type", ["b:number", "a:string"], "number"),
        f("returns", returns="Promise<void>"),
        f("calls", calls=["y", "z"]),
        f("body", body="{ 2 }"),
        f("Kept", body="class { 2 }", kind="CLASS"),
        f("nulls", [], "", [], "", "METHOD", "C"),
    ]
    events = semantic.symbol_events(side(spark, old), side(spark, new))
    got = sorted((r.symbol_id.removeprefix("FUNCTION:f.ts:"), r.kind, r.detail, r["from"], r["to"]) for r in events.collect())
    assert got == sorted(
        [
            ("gone", "FUNCTION_REMOVED", None, None, None),
            ("CLASS:f.ts:Gone", "CLASS_REMOVED", None, None, None),
            ("METHOD:f.ts:C.gone", "METHOD_REMOVED", None, None, None),
            ("fresh", "FUNCTION_ADDED", None, None, None),
            ("CLASS:f.ts:Fresh", "CLASS_ADDED", None, None, None),
            ("METHOD:f.ts:C.fresh", "METHOD_ADDED", None, None, None),
            ("more", "PARAMETER_ADDED", "b:number", None, None),
            ("more", "SIGNATURE_CHANGED", None, "a:string", "a:string|b:number"),
            ("less", "PARAMETER_REMOVED", "b:number", None, None),
            ("less", "SIGNATURE_CHANGED", None, "a:string|b:number", "a:string"),
            ("order_and_type", "RETURN_TYPE_CHANGED", None, "void", "number"),
            ("order_and_type", "SIGNATURE_CHANGED", None, "a:string|b:number", "b:number|a:string"),
            ("returns", "RETURN_TYPE_CHANGED", None, "void", "Promise<void>"),
            ("calls", "CALL_ADDED", "z", None, None),
            ("calls", "CALL_REMOVED", "x", None, None),
            ("body", "BODY_CHANGED", None, None, None),
        ],
        key=lambda x: (x[0], x[1]),
    )
    assert [tuple(r) for r in semantic.change_categories(events).collect()] == [(1, "f.ts", "STRUCTURAL")]
    for kind, category in (("RETURN_TYPE_CHANGED", "INTERFACE"), ("CALL_ADDED", "BEHAVIORAL")):
        assert semantic.change_categories(events.where(f"kind = '{kind}'")).first().category == category


def test_without_an_old_side_symbols_about_changed_lines_have_other_bodies(spark):
    changed = spark.createDataFrame([(1, "f.ts", "@@ -2,1 +2,1 @@\n+x", "a\nx", None), (2, "f.ts", "@@ -2,1 +2,1 @@\n+x", "a\nx", "a\n")], "change long, path string, patch string, content string, old_content string")
    new = spark.createDataFrame([(c, "f.ts", "FUNCTION", None, n, [], "", [], n, s, e) for c in (1, 2) for n, s, e in (("near", 2, 3), ("far", 5, 9))], SIDE)
    got = sorted((r.change, r.name, r.kind) for r in semantic.semantic_diff(changed, new.limit(0), new).collect())
    assert got == [(1, "near", "BODY_CHANGED"), (2, "far", "FUNCTION_ADDED"), (2, "near", "FUNCTION_ADDED")]


def test_symbols_of_both_sides(spark):
    patch = "@@ -1,3 +1,2 @@\n keep\n-cut\n+put\n@@ -9,1 +8,0 @@\n-late"
    changed = spark.createDataFrame([(7, "f.ts", patch)], "change long, path string, patch string")
    spans = "change long, path string, kind string, owner string, name string, start_line int, end_line int"
    new = spark.createDataFrame([(7, "f.ts", "METHOD", "C", "m", 2, 2), (7, "f.ts", "CLASS", None, "C", 1, 4), (8, "f.ts", "FUNCTION", None, "other", 1, 9)], spans)
    old = spark.createDataFrame([(7, "f.ts", "METHOD", "C", "m", 2, 2), (7, "f.ts", "FUNCTION", None, "late", 8, 9)], spans)
    got = sorted((r.change, r.kind, r.owner, r.name) for r in semantic.changed_symbols(changed, new, old).collect())
    assert got == [(7, "FUNCTION", None, "late"), (7, "METHOD", "C", "m")]


# Expected edges


def judged(e, edges):
    """One expectation against every edge."""
    kind = e["type"] or "CALLS"
    leaves = lambda x: (not e["src"] or x["src"] == e["src"]) and (not e["src_part"] or e["src_part"] in x["src"])
    arrives = lambda x: (not e["dst"] or x["dst"] == e["dst"]) and (not e["dst_part"] or e["dst_part"] in x["dst"])
    some = any(e[k] for k in ("src", "dst", "src_part", "dst_part"))
    own = [x for x in edges if x["type"] == kind]
    hits = [x for x in own if some and leaves(x) and arrives(x)]
    if e["forbidden"]:
        return ("FALSE_POSITIVE", hits[0]["id"]) if hits else ("TRUE_POSITIVE", None)
    if hits:
        return ("LOW_CONFIDENCE" if hits[0]["confidence"] == "LOW" else "TRUE_POSITIVE", hits[0]["id"])
    other = [x for x in edges if e["src"] and e["dst"] and (x["src"], x["dst"]) == (e["src"], e["dst"]) and x["type"] != kind]
    if other:
        return "WRONG_TYPE", other[0]["id"]
    out = [x for x in own if leaves(x)] if (e["src"] or e["src_part"]) and e["dst"] else []
    return ("WRONG_TARGET", out[0]["id"]) if len(out) == 1 and out[0]["dst"] != e["dst"] else ("MISSING_EDGE", None)


def test_expectations_are_classed_as_by_all_pairs(spark):
    rng = random.Random(12)
    names = ["FILE:src/a.ts", "FILE:src/ab.ts", "FUNCTION:src/a.ts:run", "METHOD:b.ts:C.run", "METHOD:b.ts:C.go", "x", "aé", ""]
    edges = [dict(id=f"e{i:03}", src=rng.choice(names[:-1]), dst=rng.choice(names[:-1]), type=rng.choice(["CALLS", "IMPORTS", "USES"]), confidence=rng.choice(["HIGH", "LOW"]), seq=i) for i in range(40)]
    parts = ["src/", "a", "ab", "run", ":C.", "é", "none", "src/a.ts:run", "", None]
    pick = lambda some: rng.choice([None, *some])
    wanted = []
    for i in range(400):
        wanted.append(dict(id=i, type=pick(["CALLS", "IMPORTS"]), src=pick(names), dst=pick([*names, "nowhere"]), src_part=pick(parts), dst_part=pick(parts), forbidden=rng.random() < 0.2, soft=None))
    wanted.append(dict(id=400, type=None, src=None, dst="", src_part=None, dst_part=None, forbidden=False, soft=True))
    table = spark.createDataFrame([tuple(e.values()) for e in edges], "id string, src string, dst string, type string, confidence string, seq long")
    asked = spark.createDataFrame([tuple(w.values()) for w in wanted], "id long, type string, src string, dst string, src_part string, dst_part string, forbidden boolean, soft boolean")
    classed = expectations.classify(asked, table)
    got = {r.id: (r["class"], r.edge_id) for r in classed.collect()}
    assert got == {w["id"]: judged(w, edges) for w in wanted}
    assert {c for c, _ in got.values()} == {"TRUE_POSITIVE", "FALSE_POSITIVE", "LOW_CONFIDENCE", "WRONG_TYPE", "WRONG_TARGET", "MISSING_EDGE"}
    plan = classed._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert expectations.classify(asked.limit(0), table).collect() == []
    assert {r["class"] for r in expectations.classify(asked, table.limit(0)).collect()} == {"TRUE_POSITIVE", "MISSING_EDGE"}


def most_rows(df):
    """The most rows that a step of a query has put out, once it has run."""
    df.collect()

    def of(plan):
        kind = plan.getClass().getSimpleName()
        below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(of, below)])

    return of(df._jdf.queryExecution().executedPlan())


def test_expectations_with_a_common_part_are_looked_up_by_their_other_end(spark):
    table = spark.createDataFrame([(f"e{i}", f"ROUTE:{i}", f"PART:{i:03}", "CALLS", "HIGH", i) for i in range(300)], "id string, src string, dst string, type string, confidence string, seq long")
    asked = spark.createDataFrame([(i, None, None, None, "E:", f"ART:{i:03}", False, None) for i in range(300)], "id long, type string, src string, dst string, src_part string, dst_part string, forbidden boolean, soft boolean")
    classed = expectations.classify(asked, table)
    assert {(r.id, r.edge_id) for r in classed.collect()} == {(i, f"e{i}") for i in range(300)}
    assert most_rows(classed) <= 900


def dealt_rows(df):
    """The rows that a query's shuffles write, once it has run."""
    df.collect()

    def of(plan):
        kind = plan.getClass().getSimpleName()
        below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().get("shuffleRecordsWritten")
        return (own.get().value() if own.isDefined() else 0) + sum(map(of, below))

    return of(df._jdf.queryExecution().executedPlan())


def test_edges_that_no_expectation_looks_at_are_not_dealt_out(spark):
    table = spark.createDataFrame([(f"e{i}", f"ROUTE:{i}", f"PART:{i:04}", "CALLS", "HIGH", i) for i in range(5000)], "id string, src string, dst string, type string, confidence string, seq long")
    wanted = [(0, None, "ROUTE:7", "PART:0007", None, None, False, None), (1, "USES", "ROUTE:8", "PART:0008", None, None, False, None), (2, None, None, None, None, "T:0009", False, None), (3, None, "ROUTE:9", "x", None, None, False, None)]
    asked = spark.createDataFrame(wanted, "id long, type string, src string, dst string, src_part string, dst_part string, forbidden boolean, soft boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        classed = expectations.classify(asked, table)
        dealt = dealt_rows(classed)
        got = {r.id: (r["class"], r.edge_id) for r in classed.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {0: ("TRUE_POSITIVE", "e7"), 1: ("WRONG_TYPE", "e8"), 2: ("TRUE_POSITIVE", "e9"), 3: ("WRONG_TARGET", "e9")}
    assert 0 < dealt < 200


def test_a_node_that_holds_a_part_twice_is_found_once(spark):
    ids, parts = ["E:E:E:", "abcabcabcabc", "aéaéaéaéaéé", "é", "x"], ["E:", "abc", "abcabcabc", "éaéaéaéa", "é", "aéaé", "none", "a longer one", ""]
    rows = expectations.holders(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(i,) for i in ids + ids], "id string")).collect()
    assert sorted((r.part, r.id) for r in rows) == sorted((p, i) for p in parts for i in ids if p and p in i)


def test_pairs_of_deduped_edges_are_dealt_out_once(spark):
    rows = [("a", "b", "CALLS", "LOW", 2, None), ("a", "b", "CALLS", "HIGH", 1, "x"), ("a", "b", "CONTAINS", "LOW", 0, None)]
    edges = graph.dedupe_edges(spark.createDataFrame(rows, "src string, dst string, type string, confidence string, seq long, evidence string"))
    pairs = graph.live_pairs(edges)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 0, "LOW")]


def test_paths_carry_their_types_and_marks(spark):
    """No edge is looked up again to explain a path, and one table of pairs tells of tests too."""
    rows = [("b", "a", "USES", "LOW", 2), ("b", "a", "CONTAINS", "HIGH", 1), ("c", "b", "CALLS", "HIGH", 3), ("t", "a", "TESTS", "HIGH", 4), ("a", "z", "CONTAINS", "HIGH", 5)]
    edges = spark.createDataFrame(rows, "src string, dst string, type string, confidence string, seq long")
    marked = graph.pairs(edges, ("TESTS",), typed=True)
    assert {(r.src, r.dst): (r.pair_seq, r.confidence, r.live, r.TESTS, r.type) for r in marked.collect()} == {
        ("b", "a"): (1, "HIGH", True, False, "CONTAINS"),
        ("c", "b"): (3, "HIGH", True, False, "CALLS"),
        ("t", "a"): (4, "HIGH", True, True, "TESTS"),
        ("a", "z"): (5, "HIGH", False, False, "CONTAINS"),
    }
    found = graph.reached(spark.createDataFrame([("a", 0)], "id string, rank long"), marked.where("live"))
    told = impact.explain(found)
    assert sorted(tuple(r) for r in told.collect()) == [("b", 0, "b", "a", "CONTAINS"), ("c", 0, "b", "a", "CONTAINS"), ("c", 1, "c", "b", "CALLS"), ("t", 0, "t", "a", "TESTS")]
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_edges_about_nodes_are_made_once(spark):
    rows = [("a", "b", "CALLS", "LOW", 2, None), ("b", "a", "USES", "HIGH", 1, "x"), ("a", "a", "USES", "HIGH", 3, "x")]
    edges = graph.dedupe_edges(spark.createDataFrame(rows, "src string, dst string, type string, confidence string, seq long, evidence string"))
    nodes = spark.createDataFrame([("a", "FILE", "A"), ("b", "FILE", "B")], "id string, type string, name string")
    about = graph.related(nodes.where("id = 'a'").select("id"), edges, nodes)
    assert sorted((r.id, r.direction, r.other, r.type, r.other_name) for r in about.collect()) == [("a", "in", "a", "USES", "A"), ("a", "in", "b", "USES", "B"), ("a", "out", "a", "USES", "A"), ("a", "out", "b", "CALLS", "B")]
    assert about._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_admission_carries_no_ids_through_its_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    plan = catalog.QUERIES["edge_admission"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" in plan and "->" not in plan[plan.index("Join") :]


def test_edges_to_one_node_are_counted_before_its_type_is_looked_up(spark):
    nodes = spark.createDataFrame([("hub", "MODULE"), ("other", "FILE"), *[(f"f{i}", "FILE") for i in range(50)]], "id string, type string")
    edges = spark.createDataFrame([*[(f"f{i}", "hub") for i in range(50)], ("f1", "other"), ("f2", "nowhere")], "src string, dst string")
    counts = tables.cross_counts(edges, nodes)
    assert [tuple(r) for r in counts.collect()] == [("FILE", "MODULE", 50)]
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_rounds_of_cycles_send_nothing_to_the_driver(spark, monkeypatch):
    plans = []

    def spied(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(cycles, "written", spied)
    edges = spark.createDataFrame([(f"FILE:{a}", f"FILE:{b}") for a, b in ("ab", "bc", "ca", "cd")], "src string, dst string")
    found = cycles.circular_dependencies(edges)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert [(r.file, r.size) for r in found.collect()] == [("a", 3)]
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
