"""The wired graph on hand-written tables."""

import pytest

from ripplet.operators import graph, wiring

CALLER = "caller_kind string, caller_owner string, caller string"
SCHEMAS = {
    "files": "path string, seq long",
    "symbols": "path string, seq long, no int, kind string, owner string, name string, exported boolean",
    "variables": "path string, seq long, no int, name string",
    "imports": "path string, seq long, no int, specifier string, names array<string>, default_name string, resolved string",
    "calls": f"path string, seq long, no int, {CALLER}, callee string, kind string, file string, owner string, symbol string, confidence string, line int",
    "queries": f"path string, seq long, no int, {CALLER}, model string, method string, orm string",
    "dependencies": "path string, seq long, no int, owner string, type_name string",
    "routes": "id string, file string, seq long, no int, framework string, method string, route string, handler_name string, handler_class string, handler_file string, confidence string",
    "test_files": "path string",
}
FILES = [("a.ts", 0), ("b.ts", 1), ("c.ts", 2), ("a.test.ts", 3)]
SYMBOLS = [
    ("a.ts", 0, 0, "FUNCTION", None, "run", True),
    ("a.ts", 0, 1, "CLASS", None, "Both", False),
    ("a.ts", 0, 2, "METHOD", "Both", "go", False),
    ("b.ts", 1, 0, "FUNCTION", None, "run", False),
    ("b.ts", 1, 1, "FUNCTION", None, "Both", True),
    ("b.ts", 1, 2, "CLASS", None, "Both", True),
    ("c.ts", 2, 0, "FUNCTION", None, "lone", True),
    ("c.ts", 2, 1, "FUNCTION", None, "lone", True),
    ("c.ts", 2, 2, "CLASS", None, "Solo", False),
]


def built(spark, **given):
    rows = {"files": FILES, "symbols": SYMBOLS} | given
    tables = [spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()]
    return wiring.wired(*tables)


def triples(edges, *types):
    return sorted((r.src, r.dst, r.type, r.confidence) for r in edges.collect() if r.type in types)


def call(no, kind, file=None, owner=None, symbol=None, confidence="HIGH", callee="f", path="a.ts", caller=("FUNCTION", None, "run"), line=7):
    return (path, dict(FILES)[path], no, *caller, callee, kind, file, owner, symbol, confidence, line)


def test_symbols_and_variables_hang_on_their_files(spark):
    _, edges = built(spark, variables=[("a.ts", 0, 0, "PORT")])
    held = triples(edges, "CONTAINS", "EXPORTS", "READS")
    assert ("CLASS:a.ts:Both", "METHOD:a.ts:Both.go", "CONTAINS", "HIGH") in held
    assert ("FILE:a.ts", "METHOD:a.ts:Both.go", "CONTAINS", "HIGH") in held
    assert ("FILE:a.ts", "ENV_VARIABLE:a.ts:PORT", "READS", "HIGH") in held
    assert [e[1] for e in held if e[2] == "EXPORTS"] == ["FUNCTION:a.ts:run", "CLASS:b.ts:Both", "FUNCTION:b.ts:Both", "FUNCTION:c.ts:lone"]


def test_imports_use_functions_before_classes_and_names_that_are_unique(spark):
    imports = [
        ("a.ts", 0, 0, "./b", ["Both", "lone", "run", "nothing", "x"], None, "b.ts"),
        ("a.ts", 0, 1, "./c", [], "thing", "c.ts"),
        ("a.ts", 0, 2, "./c", None, None, "c.ts"),
        ("a.ts", 0, 3, "react", ["run"], None, None),
        ("a.ts", 0, 4, "./gone", ["lone"], None, "gone.ts"),
        ("a.test.ts", 3, 0, "./a", [], "", "a.ts"),
        ("a.test.ts", 3, 1, "./a.test", [], "", "a.test.ts"),
    ]
    _, edges = built(spark, imports=imports, test_files=[("a.test.ts",)])
    assert triples(edges, "USES") == [
        ("FILE:a.ts", "FUNCTION:b.ts:Both", "USES", "HIGH"),
        ("FILE:a.ts", "FUNCTION:b.ts:run", "USES", "HIGH"),
        ("FILE:a.ts", "FUNCTION:c.ts:lone", "USES", "MEDIUM"),
    ]
    assert triples(edges, "TESTS") == [("FILE:a.test.ts", "FILE:a.ts", "TESTS", "HIGH")]
    said = {r.dst: r.evidence for r in edges.where("type = 'IMPORTS'").collect()}
    assert said["FILE:b.ts"].snippet == 'import { Both, lone, run, nothing, … } from "./b"'
    assert said["FILE:b.ts"].resolved_through == "./b → b.ts"
    assert said["FILE:c.ts"].snippet == 'import thing from "./c"'
    assert said["FILE:a.ts"].snippet == 'import "./a"'
    assert set(said) == {"FILE:a.ts", "FILE:b.ts", "FILE:c.ts"}


def test_calls_find_what_is_there_or_the_one_function_of_that_name(spark):
    calls = [
        call(0, "METHOD", "a.ts", "Both", "go"),
        call(1, "CLASS", "c.ts", None, "Solo", "MEDIUM"),
        call(2, "FUNCTION", "b.ts", None, "run", "LOW"),
        call(3, "FUNCTION", "a.ts", None, "run"),  # itself
        call(4, "FUNCTION", "barrel.ts", None, "lone", "MEDIUM"),  # by name
        call(5, "FUNCTION", None, None, "lone", "LOW"),
        call(6, "FUNCTION", "", None, "run"),  # two of that name
        call(7, "FUNCTION", "b.ts", None, None),
        call(8, "METHOD", "b.ts", "Both", "gone"),
        call(9, "UNRESOLVED", "b.ts", None, "run"),
        call(10, "MODULE", "b.ts", None, "Both", "MEDIUM"),
        call(11, "MODULE", None, None, "Both"),
        call(12, "CLASS", "barrel.ts", None, "Solo"),  # only functions are looked for by name
    ]
    _, edges = built(spark, calls=calls)
    run = "FUNCTION:a.ts:run"
    assert triples(edges, "CALLS") == [
        (run, "CLASS:c.ts:Solo", "CALLS", "MEDIUM"),
        (run, "FUNCTION:b.ts:run", "CALLS", "LOW"),
        (run, "FUNCTION:c.ts:lone", "CALLS", "MEDIUM"),
        (run, "METHOD:a.ts:Both.go", "CALLS", "HIGH"),
    ]
    assert triples(edges, "IMPORTS") == [("FILE:a.ts", "FILE:b.ts", "IMPORTS", "MEDIUM"), (run, "FILE:b.ts", "IMPORTS", "MEDIUM")]


def test_parallel_calls_are_one_edge_of_the_first_evidence_and_the_best_confidence(spark):
    calls = [call(n, "FUNCTION", "b.ts", None, "run", c, callee=f"f{n}", line=n) for n, c in ((4, "HIGH"), (2, "LOW"), (3, "MEDIUM"))]
    row = built(spark, calls=calls)[1].where("type = 'CALLS'").collect()
    assert len(row) == 1 and row[0].confidence == "HIGH" and row[0].id == "FUNCTION:a.ts:run->FUNCTION:b.ts:run:CALLS"
    assert tuple(row[0].evidence) == ("a.ts", 2, "f2(…)", "function run in b.ts", "f2")


def test_hosts_and_models_are_made_on_demand_and_the_first_tells_about_them(spark):
    calls = [
        call(5, "EXTERNAL", None, None, "api.x.org", "MEDIUM", "fetch", "b.ts"),
        call(0, "EXTERNAL", None, None, "api.x.org", "MEDIUM", "fetch", "c.ts", ("FUNCTION", None, "lone")),
        call(1, "EXTERNAL"),
        call(2, "QUERY", None, "Prisma.User", None, callee="findMany"),
        call(3, "QUERY", None, "Prisma.User", None, callee="create"),
        call(4, "QUERY", None, "Plain", None),
    ]
    queries = [("b.ts", 1, 9, "FUNCTION", None, "run", "Order", "Find", "gorm")]
    nodes, edges = built(spark, calls=calls, queries=queries)
    made = {r.id: (r.type, r.name, r.file, r.metadata) for r in nodes.where("metadata is not null").collect()}
    assert made == {
        "EXTERNAL_SERVICE:api.x.org": ("EXTERNAL_SERVICE", "api.x.org", "b.ts", {"kind": "http", "via": "fetch"}),
        "EXTERNAL_SERVICE:http": ("EXTERNAL_SERVICE", "http", "a.ts", {"kind": "http", "via": "fetch"}),
        "DATABASE_MODEL:prisma:User": ("DATABASE_MODEL", "User", "a.ts", {"orm": "prisma", "method": "findMany"}),
        "DATABASE_MODEL:b.ts:Order": ("DATABASE_MODEL", "Order", "b.ts", {"orm": "gorm", "method": "Find"}),
    }
    assert triples(edges, "QUERIES") == [
        ("FUNCTION:a.ts:run", "DATABASE_MODEL:prisma:User", "QUERIES", "HIGH"),
        ("FUNCTION:b.ts:run", "DATABASE_MODEL:b.ts:Order", "QUERIES", "MEDIUM"),
    ]
    assert [e[0] for e in triples(edges, "FETCHES")] == ["FUNCTION:a.ts:run", "FUNCTION:b.ts:run", "FUNCTION:c.ts:lone"]


def test_dependencies_take_the_one_class_else_that_of_the_file(spark):
    rows = [("a.ts", 0, n, "Both", t) for n, t in enumerate(("Solo", "Both", "Nowhere"))] + [("c.ts", 2, 0, "Solo", "Both"), ("b.ts", 1, 0, "Both", "Solo")]
    _, edges = built(spark, dependencies=rows)
    assert triples(edges, "DEPENDS_ON") == [
        ("CLASS:a.ts:Both", "CLASS:c.ts:Solo", "DEPENDS_ON", "HIGH"),
        ("CLASS:b.ts:Both", "CLASS:c.ts:Solo", "DEPENDS_ON", "HIGH"),
    ]


def test_routes_are_handled_by_methods_or_functions(spark):
    routes = [
        ("R1", "a.ts", 0, 0, "nest", "GET", "/x", "go", "Both", None, "HIGH"),
        ("R2", "a.ts", 0, 1, "express", "POST", "/y", "lone", None, "c.ts", "MEDIUM"),
        ("R3", "a.ts", 0, 2, "next", "ALL", "/z", "default", None, None, "LOW"),
        ("R4", "gone.ts", 9, 0, "express", "GET", "/q", "run", "", None, "HIGH"),
        ("R1", "b.ts", 1, 0, "express", "PUT", "/later", None, None, None, "LOW"),
    ]
    nodes, edges = built(spark, routes=routes)
    made = {r.id: (r.name, r.file, r.metadata.get("handlerName", r.metadata.get("handler_name"))) for r in nodes.where("type = 'API_ROUTE'").collect()}
    assert made == {"R1": ("GET /x", "a.ts", "go"), "R2": ("POST /y", "a.ts", "lone"), "R3": ("ALL /z", "a.ts", "default"), "R4": ("GET /q", "gone.ts", "run")}
    assert triples(edges, "HANDLED_BY", "USES") == [
        ("R1", "METHOD:a.ts:Both.go", "HANDLED_BY", "HIGH"),
        ("R2", "FUNCTION:c.ts:lone", "HANDLED_BY", "MEDIUM"),
        ("R2", "FUNCTION:c.ts:lone", "USES", "MEDIUM"),
    ]
    assert triples(edges, "CONFIGURES") == [("FILE:a.ts", r, "CONFIGURES", c) for r, c in (("R1", "HIGH"), ("R2", "MEDIUM"), ("R3", "LOW"))] + [("FILE:b.ts", "R1", "CONFIGURES", "LOW")]


def test_a_change_reaches_callers_tests_and_routes(spark):
    given = {
        "calls": [call(0, "FUNCTION", "c.ts", None, "lone", path="a.ts")],
        "routes": [("R", "a.ts", 0, 0, "express", "GET", "/x", "run", None, None, "HIGH")],
    }
    _, edges = built(spark, **given)
    found = graph.blast_radius(spark.createDataFrame([("FUNCTION:c.ts:lone", 0)], "id string, rank long"), edges)
    assert {(r.id, r.depth) for r in found.collect()} == {("FUNCTION:c.ts:lone", 0), ("FUNCTION:a.ts:run", 1), ("R", 2), ("FILE:a.ts", 3)}


def test_no_rows_make_no_graph_and_numbers_out_of_range_are_an_error(spark):
    nodes, edges = built(spark, files=[], symbols=[])
    assert nodes.count() == edges.count() == 0
    with pytest.raises(Exception, match="out of range"):
        built(spark, queries=[("a.ts", 1 << 40, 0, "FUNCTION", None, "run", "M", "m", "prisma")])[1].collect()
