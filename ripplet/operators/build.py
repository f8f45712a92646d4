"""Building the dependency graph from parsed tables: files, symbols, imports and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.operators.graph import dedupe_nodes
from ripplet.operators.paths import base, file_type


def node_id(kind: str | Column, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, *parts)


def symbol_id(kind: Column, path: Column, owner: Column, name: Column) -> Column:
    """Of a function, class or method; a method's name has its class before it."""
    return F.when(kind == "METHOD", node_id("METHOD", path, F.concat_ws(".", owner, name))).otherwise(node_id(kind, path, name))


def build_nodes(files: DataFrame, symbols: DataFrame, variables: DataFrame) -> DataFrame:
    """id, type, name, file of files (path, seq), symbols (path, seq, kind, owner, name) and environment variables (path, name).
    Of rows with one id the first stands: files come before symbols, and these before variables."""
    path = F.col("path")
    order = lambda n, seq: F.struct(F.lit(n).alias("kind"), seq.cast("long").alias("seq")).alias("seq")
    own = files.select(node_id("FILE", path).alias("id"), file_type(path).alias("type"), base(path).alias("name"), path.alias("file"), order(0, F.col("seq")))
    full = F.when(F.col("kind") == "METHOD", F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))
    inner = symbols.select(symbol_id(F.col("kind"), path, F.col("owner"), F.col("name")).alias("id"), F.col("kind").alias("type"), full.alias("name"), path.alias("file"), order(1, F.col("seq")))
    env = variables.select(node_id("ENV_VARIABLE", path, F.col("name")).alias("id"), F.lit("ENV_VARIABLE").alias("type"), "name", path.alias("file"), order(2, F.lit(0)))
    every = own.unionByName(inner).unionByName(env)
    return dedupe_nodes(every).drop("seq")


def contained(symbols: DataFrame, variables: DataFrame) -> DataFrame:
    """CONTAINS, EXPORTS and READS edges (src, dst, type, confidence): from files to their symbols and variables, and from
    classes to their methods."""
    ident = symbol_id(F.col("kind"), F.col("path"), F.col("owner"), F.col("name"))
    rows = symbols.select(node_id("FILE", F.col("path")).alias("file"), ident.alias("dst"), node_id("CLASS", F.col("path"), F.col("owner")).alias("class"), "kind", "exported")
    edge = lambda src, kind: F.struct(F.col(src).alias("src"), F.lit(kind).alias("type"))
    method = F.col("kind") == "METHOD"
    made = F.array_compact(F.array(edge("file", "CONTAINS"), F.when(method, edge("class", "CONTAINS")), F.when(~method & F.col("exported"), edge("file", "EXPORTS"))))
    held = rows.select("dst", F.explode(made).alias("e")).select("e.src", "dst", "e.type")
    reads = variables.select(node_id("FILE", F.col("path")).alias("src"), node_id("ENV_VARIABLE", F.col("path"), F.col("name")).alias("dst"), F.lit("READS").alias("type"))
    return held.unionByName(reads).distinct().withColumn("confidence", F.lit("HIGH"))


def imported(imports: DataFrame) -> DataFrame:
    """IMPORTS edges of resolved imports (path, resolved)."""
    found = imports.where("resolved is not null").select(node_id("FILE", F.col("path")).alias("src"), node_id("FILE", F.col("resolved")).alias("dst"))
    return found.where("src <> dst").distinct().select("src", "dst", F.lit("IMPORTS").alias("type"), F.lit("HIGH").alias("confidence"))


def used(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """USES edges of the names (an array) of resolved imports: to the function in the file, else to the class, else to the
    one function or class of that name anywhere, with less confidence."""
    names = imports.where("resolved is not null").select("path", "resolved", F.explode("names").alias("name")).distinct()
    known = symbols.where("kind in ('FUNCTION', 'CLASS')").select("path", "kind", "name").distinct()
    here = known.groupBy(F.col("path").alias("resolved"), "name").agg(F.max("kind").alias("kind"))  # FUNCTION comes after CLASS
    one = known.groupBy("name").agg(F.count("*").alias("n"), F.min(node_id(F.col("kind"), F.col("path"), F.col("name"))).alias("other")).where("n = 1")
    joined = names.join(here, ["resolved", "name"], "left").join(one.select("name", "other"), "name", "left")
    dst = F.when(F.col("kind").isNotNull(), node_id(F.col("kind"), F.col("resolved"), F.col("name"))).otherwise(F.col("other"))
    sure = F.when(F.col("kind").isNotNull(), "HIGH").otherwise("MEDIUM")
    edges = joined.select(node_id("FILE", F.col("path")).alias("src"), dst.alias("dst"), F.lit("USES").alias("type"), sure.alias("confidence"))
    return edges.where("dst is not null").distinct()


def tested(files: DataFrame, imports: DataFrame) -> DataFrame:
    """TESTS edges: from test files to the files that they import."""
    tests = files.where(file_type(F.col("path")) == "TEST").select("path")
    return imported(imports.join(tests, "path", "left_semi")).withColumn("type", F.lit("TESTS"))


def call_target(call: str = "c") -> Column:
    """The id that a resolved call (kind, file, owner, symbol) aims at; null if it aims at nothing known."""
    at = lambda x: F.col(f"{call}.{x}")
    kind, file, symbol = at("kind"), at("file"), at("symbol")
    model = F.when(F.startswith(at("owner"), F.lit("Prisma.")), node_id("DATABASE_MODEL", F.coalesce(file, F.lit("prisma")), F.substring(at("owner"), 8, 1_000)))
    inner = (
        F.when((kind == "METHOD") & at("owner").isNotNull(), node_id("METHOD", file, F.concat_ws(".", at("owner"), symbol)))
        .when(kind == "CLASS", node_id("CLASS", file, symbol))
        .otherwise(node_id("FUNCTION", file, symbol))
    )
    return (
        F.when(kind == "UNRESOLVED", F.lit(None).cast("string"))
        .when(kind == "EXTERNAL", node_id("EXTERNAL_SERVICE", F.coalesce(symbol, file, F.lit("http"))))
        .when(kind == "MODULE", F.when(file.isNotNull(), node_id("FILE", file)))
        .when(kind == "QUERY", model)
        .when(file.isNotNull() & symbol.isNotNull(), inner)
    )
