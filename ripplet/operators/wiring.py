"""The whole dependency graph of parsed tables: nodes made on demand, edges with evidence and places, admitted and without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.operators.build import build_nodes, call_target, node_id, symbol_id
from ripplet.operators.graph import dedupe_edges, dedupe_nodes, edge_id, unique_names
from ripplet.sources.scratch import written

EVIDENCE = "struct<file: string, start_line: int, snippet: string, resolved_through: string, symbol: string>"
#: Bits of an edge's place: part of the build, file, phase, number in the file twice. 60 in all, as traversal takes four times it.
FILE_BITS, PHASE_BITS, NUMBER_BITS = 32, 3, 23
#: Handler names that stand for the whole route, not for a function.
NO_HANDLER = ("default", "ALL")


def place(part: int, file: Column, phase: int, number: Column | int = 0, second: int = 0) -> Column:
    """Where an edge stands: by part (symbols, bodies, routes), file, phase and number. What doesn't fit is an error, not another order."""
    number = (number if isinstance(number, Column) else F.lit(number)).cast("long") * 2 + second
    file = file.cast("long")
    fits = file.between(0, (1 << FILE_BITS) - 1) & number.between(0, (1 << NUMBER_BITS) - 1)
    whole = ((F.lit(part) * (1 << FILE_BITS) + file) * (1 << PHASE_BITS) + phase) * (1 << NUMBER_BITS) + number
    return F.when(fits, whole).otherwise(F.raise_error(F.lit("a file's seq or a row's no is out of range")).cast("long"))


def _evidence(file: Column, snippet: Column, through: Column, symbol: Column | None = None, line: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    parts = (file, F.lit(None).cast("int") if line is None else line.cast("int"), snippet, through, none if symbol is None else symbol)
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("file", "start_line", "snippet", "resolved_through", "symbol"))]).cast(EVIDENCE)


def _edge(src: Column, dst: Column, kind: str | Column, confidence: str | Column, seq: Column, evidence: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast(EVIDENCE)
    parts = {"src": src, "dst": dst, "type": lit(kind), "confidence": lit(confidence), "evidence": none if evidence is None else evidence, "seq": seq}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _rows(df: DataFrame, *edges: Column) -> DataFrame:
    """One row for each edge that isn't null: one pass over df, however many edges a row has."""
    return df.select(F.explode(F.array_compact(F.array(*edges))).alias("e")).select("e.*")


def _file(path: str = "path") -> Column:
    return node_id("FILE", F.col(path))


def caller() -> Column:
    """The id of the symbol whose body holds a row: (path, caller_kind, caller_owner, caller)."""
    return symbol_id(F.col("caller_kind"), F.col("path"), F.col("caller_owner"), F.col("caller"))


def symbol_edges(symbols: DataFrame, variables: DataFrame) -> DataFrame:
    """CONTAINS and EXPORTS of symbols (path, seq, no, kind, owner, name, exported) and READS of variables (path, seq, no, name)."""
    path = F.col("path")
    ident = symbol_id(F.col("kind"), path, F.col("owner"), F.col("name"))
    method = F.col("kind") == "METHOD"
    at = lambda phase: place(0, F.col("seq"), phase, F.col("no"))
    held = _rows(
        symbols,
        F.when(method, _edge(node_id("CLASS", path, F.col("owner")), ident, "CONTAINS", "HIGH", at(0))),
        _edge(_file(), ident, "CONTAINS", "HIGH", at(1)),
        F.when(~method & F.col("exported"), _edge(_file(), ident, "EXPORTS", "HIGH", at(2))),
    )
    return held.unionByName(_rows(variables, _edge(_file(), node_id("ENV_VARIABLE", path, F.col("name")), "READS", "HIGH", at(3))))


def import_edges(imports: DataFrame, symbols: DataFrame, test_files: DataFrame) -> DataFrame:
    """IMPORTS, USES and, from test_files (path), TESTS of imports (path, seq, no, specifier, names, default_name, resolved).

    A name is used in the function of the file, else in its class, else in the one function or class of that name anywhere (MEDIUM).
    The evidence of an import shows four of its names. Imports without a resolved file have no edges."""
    some = imports.where("resolved is not null").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    spec, seq, no = F.col("specifier"), F.col("seq"), F.col("no")
    more = F.when(F.size("names") > 4, ", …").otherwise("")
    listed = F.concat(F.lit("import { "), F.array_join(F.slice("names", 1, 4), ", "), more, F.lit(' } from "'), spec, F.lit('"'))
    default = F.nullif("default_name", F.lit(""))
    plain = F.when(default.isNotNull(), F.concat(F.lit("import "), default, F.lit(' from "'), spec, F.lit('"'))).otherwise(F.concat(F.lit('import "'), spec, F.lit('"')))
    through = F.concat(spec, F.lit(" → "), "resolved")
    whole = _evidence(F.col("path"), F.when(F.size("names") > 0, listed).otherwise(plain), through)
    direct = _rows(some, _edge(_file(), _file("resolved"), "IMPORTS", "HIGH", place(1, seq, 0, no), whole))
    tests = _rows(some.join(test_files.select("path").distinct(), "path", "left_semi"), _edge(_file(), _file("resolved"), "TESTS", "HIGH", place(1, seq, 3, no)))

    known = symbols.where("kind in ('FUNCTION', 'CLASS')").select("path", "kind", "name").distinct()
    here = known.groupBy(F.col("path").alias("resolved"), "name").agg(F.max("kind").alias("kind"))  # FUNCTION comes after CLASS
    one = unique_names(known.select(node_id(F.col("kind"), F.col("path"), F.col("name")).alias("id"), F.col("kind").alias("type"), "name"), ("FUNCTION", "CLASS"))
    named = some.select("path", "seq", "no", "specifier", "resolved", F.explode("names").alias("name"))
    met = named.join(here, ["resolved", "name"], "left").join(one, "name", "left")
    there = F.col("kind").isNotNull()
    dst = F.when(there, node_id(F.col("kind"), F.col("resolved"), F.col("name"))).otherwise(F.col("id"))
    snippet = F.concat(F.lit("import { "), "name", F.lit(' } from "'), spec, F.lit('"'))
    uses = _edge(_file(), dst, "USES", F.when(there, "HIGH").otherwise("MEDIUM"), place(1, seq, 0, no, 1), _evidence(F.col("path"), snippet, through, F.col("name")))
    return direct.unionByName(tests).unionByName(_rows(met.where(dst.isNotNull()), uses))


def resolved_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds target to calls (kind, file, owner, symbol): the id that a call aims at. A function that isn't where it should be, or
    whose file isn't known, is the one function of that name anywhere, if there is just one. Calls that lead nowhere go. An empty
    file, owner or symbol is none, but for hosts and models, which are named by what is there."""
    named = ("file", "owner", "symbol")
    some = lambda c: F.when(~F.col("kind").isin("EXTERNAL", "QUERY"), F.nullif(F.col(c), F.lit(""))).otherwise(F.col(c))
    full = calls.withColumns({c: some(c) for c in named}).withColumn("__call", F.struct("kind", *named))
    aimed = full.withColumn("target", call_target("__call")).drop("__call")
    functions = nodes.where("type = 'FUNCTION'")
    looked = aimed.where("kind = 'FUNCTION' and symbol is not null")
    there = functions.select(F.col("id").alias("target"), F.lit(True).alias("__there"))
    # Only calls whose file is known ask for the id; the others would all meet as one null key.
    exact = looked.where("target is not null").join(there, "target", "left")
    lost = exact.where("__there is null").drop("__there").unionByName(looked.where("target is null"))
    one = unique_names(nodes, ("FUNCTION",)).select(F.col("name").alias("symbol"), F.col("id").alias("__one"))
    found = lost.drop("target").join(one, "symbol", "inner").withColumnRenamed("__one", "target")
    rest = aimed.where("not (kind <=> 'FUNCTION' and symbol is not null) and target is not null")
    return rest.unionByName(exact.where("__there").drop("__there")).unionByName(found)


def call_edges(targeted: DataFrame) -> DataFrame:
    """Edges of calls with targets (resolved_calls): IMPORTS of modules, from the symbol and from its file; QUERIES, FETCHES, CALLS."""
    kind, name = F.col("kind"), F.coalesce("symbol", "callee")
    said = F.concat(F.lower(kind), F.lit(" "), name)
    through = F.when(F.col("file").isNotNull(), F.concat(said, F.lit(" in "), "file")).otherwise(said)
    proof = _evidence(F.col("path"), F.concat("callee", F.lit("(…)")), through, F.col("callee"), F.col("line"))
    made = F.when(kind == "MODULE", "IMPORTS").when(kind == "QUERY", "QUERIES").when(kind == "EXTERNAL", "FETCHES").otherwise("CALLS")
    at = lambda second: place(1, F.col("seq"), 2, F.col("no"), second)
    sure = F.col("confidence")
    return _rows(targeted, _edge(caller(), F.col("target"), made, sure, at(0), proof), F.when(kind == "MODULE", _edge(_file(), F.col("target"), made, sure, at(1), proof)))


def call_nodes(targeted: DataFrame) -> DataFrame:
    """Hosts and models that calls make: id, type, name, file, metadata, seq."""
    outside = F.col("kind") == "EXTERNAL"
    model = F.regexp_replace("owner", "^Prisma\\.", "")
    about = F.when(outside, F.create_map(F.lit("kind"), F.lit("http"), F.lit("via"), F.lit("fetch"))).otherwise(F.create_map(F.lit("orm"), F.lit("prisma"), F.lit("method"), F.col("callee")))
    return targeted.where("kind in ('EXTERNAL', 'QUERY')").select(
        F.col("target").alias("id"),
        F.when(outside, "EXTERNAL_SERVICE").otherwise("DATABASE_MODEL").alias("type"),
        F.when(outside, F.coalesce("symbol", "file", F.lit("http"))).otherwise(model).alias("name"),
        F.when(outside, F.col("path")).otherwise(F.coalesce("file", "path")).alias("file"),
        about.alias("metadata"),
        place(1, F.col("seq"), 2, F.col("no")).alias("seq"),
    )


def _model() -> Column:
    return node_id("DATABASE_MODEL", F.col("path"), F.col("model"))


def query_edges(queries: DataFrame) -> DataFrame:
    """QUERIES of queries (path, seq, no, caller columns, model, method, orm) to the model of their file."""
    return _rows(queries, _edge(caller(), _model(), "QUERIES", "MEDIUM", place(1, F.col("seq"), 2, F.col("no"))))


def query_nodes(queries: DataFrame) -> DataFrame:
    about = F.create_map(F.lit("orm"), F.col("orm"), F.lit("method"), F.col("method"))
    return queries.select(_model().alias("id"), F.lit("DATABASE_MODEL").alias("type"), F.col("model").alias("name"), F.col("path").alias("file"), about.alias("metadata"), place(1, F.col("seq"), 2, F.col("no")).alias("seq"))


def dependency_edges(dependencies: DataFrame, nodes: DataFrame) -> DataFrame:
    """DEPENDS_ON of constructor parameters (path, seq, no, owner, type_name): the one class of that name, else the class of the same file.
    A class of the same file that isn't there is left to admission."""
    one = unique_names(nodes, ("CLASS",)).select(F.col("name").alias("type_name"), "id")
    met = dependencies.join(one, "type_name", "left")
    path = F.col("path")
    dst = F.coalesce(F.col("id"), node_id("CLASS", path, F.col("type_name")))
    return _rows(met, _edge(node_id("CLASS", path, F.col("owner")), dst, "DEPENDS_ON", "HIGH", place(1, F.col("seq"), 2, F.col("no"))))


def route_edges(routes: DataFrame) -> DataFrame:
    """DEPENDS_ON, CONFIGURES, HANDLED_BY and USES of routes (id, file, seq, no, handler_name, handler_class, handler_file, confidence):
    a handler with a class is a method, one without is a function; default and ALL name none."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    route, sure, at = F.col("id"), F.col("confidence"), lambda phase: place(2, F.col("seq"), phase, F.col("no"))
    home, name = F.coalesce("handler_file", "file"), some("handler_name")
    method = some("handler_class").isNotNull() & name.isNotNull()
    function = ~method & name.isNotNull() & ~name.isin(*NO_HANDLER)
    handler = F.when(method, node_id("METHOD", home, F.concat_ws(".", "handler_class", "handler_name"))).when(function, node_id("FUNCTION", home, name))
    return _rows(
        routes,
        _edge(route, _file("file"), "DEPENDS_ON", sure, at(0)),
        _edge(_file("file"), route, "CONFIGURES", sure, at(1)),
        F.when(handler.isNotNull(), _edge(route, handler, "HANDLED_BY", sure, at(2))),
        F.when(function, _edge(route, handler, "USES", sure, at(3))),
    )


def route_nodes(routes: DataFrame) -> DataFrame:
    kept = ("framework", "method", "route", "handler_name", "handler_class", "confidence")
    about = F.map_from_arrays(F.array(*[F.lit("path" if c == "route" else c) for c in kept]), F.array(*kept))
    known = F.map_filter(about, lambda _, v: v.isNotNull())
    return routes.select("id", F.lit("API_ROUTE").alias("type"), F.concat_ws(" ", "method", "route").alias("name"), "file", known.alias("metadata"), place(2, F.col("seq"), 0, F.col("no")).alias("seq"))


def wired(
    files: DataFrame, symbols: DataFrame, variables: DataFrame, imports: DataFrame, calls: DataFrame, queries: DataFrame, dependencies: DataFrame, routes: DataFrame, test_files: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name, file, metadata) and edges (id, src, dst, type, confidence, evidence, seq) of parsed tables.

    Rows of bodies (calls: path, seq, no, caller_kind, caller_owner, caller, callee, kind, file, owner, symbol, confidence, line;
    queries; dependencies) are numbered together within their file by no, and seq is their file's. Hosts, models and routes become nodes
    where rows name them, the first row of each id telling about it. Those edges stay whose ends are both nodes and differ: of parallel ones the first place, the best confidence and the first evidence. Empty tables give no rows; null
    symbols, files or names lead nowhere.

    Nodes and calls with their targets are read by several joins, so they are written once to the shared folder; the given tables are
    read up to four times, so write costly ones before. Edges are dealt out twice: by source and by target. A name that very many call aims at one row of a table of unique keys: its
    join is split by adaptive execution and nothing multiplies."""
    parsed = written(build_nodes(files, symbols, variables), "nodes")
    targeted = written(resolved_calls(calls, parsed), "calls")
    made = dedupe_nodes(call_nodes(targeted).unionByName(query_nodes(queries)).unionByName(route_nodes(routes)))
    nodes = parsed.withColumn("metadata", F.lit(None).cast("map<string,string>")).unionByName(written(made.drop("seq"), "made"))
    parts = (symbol_edges(symbols, variables), import_edges(imports, symbols, test_files), call_edges(targeted), query_edges(queries), dependency_edges(dependencies, parsed), route_edges(routes))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # A source is in the file whose row tells of it, so its edges are no more than what one task has read: dealt by source, they
    # are admitted by it and grouped in one place.
    dealt = every.where("src is not null and dst is not null and src <> dst").repartition("src")
    edges = dedupe_edges(dealt.join(nodes.select(F.col("id").alias("src")), "src", "left_semi"), dealt=True)
    # An id repeats both ends, so the join by target goes without it.
    kept = edges.drop("id").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, kept.select(edge_id().alias("id"), *[c for c in edges.columns if c != "id"])
