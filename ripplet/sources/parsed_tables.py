"""Tables as a parser would give them (symbols, imports, calls, queries, dependencies, routes), read from the files' texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.sources import driver_tables as src

KINDS = ("FUNCTION", "METHOD", "CLASS", "EXTERNAL", "MODULE", "QUERY", "UNRESOLVED")
#: Numbers of queries and dependencies come after those of calls.
QUERY_FROM, DEPENDENCY_FROM = 2_000_000, 3_000_000


def _number(n: Column) -> Column:
    return n.cast("string")


def _path(n: Column) -> Column:
    """The path of a document's file."""
    return F.replace(F.element_at(F.array(*map(F.lit, src.PATHS)), (n % len(src.PATHS) + 1).cast("int")), F.lit("{n}"), _number(n))


def symbols(files: DataFrame) -> DataFrame:
    """path, seq, no, kind, owner, name, exported: the four symbols of each file, a function whose name no other file has, and such a
    class in every second file."""
    n = F.col("seq")
    no = F.when(F.col("name") == "get", 3).when(F.col("kind") == "CLASS", 1).when(F.col("kind") == "METHOD", 2).otherwise(0)
    usual = src.symbols(files).select("path", "seq", no.alias("no"), "kind", "owner", "name", "exported")
    own = lambda at, kind, head, out: files.select(
        "path", "seq", F.lit(at).alias("no"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("owner"), F.concat(F.lit(head), _number(n)).alias("name"), F.lit(out).alias("exported")
    )
    return usual.unionByName(own(4, "FUNCTION", "only", True)).unionByName(own(5, "CLASS", "Solo", False).where("seq % 2 = 0"))


def env_variables(files: DataFrame) -> DataFrame:
    """path, seq, no, name."""
    return src.env_variables(files).join(files.select("path", "seq"), "path").select("path", "seq", F.lit(0).alias("no"), "name")


def imports(files: DataFrame) -> DataFrame:
    """path, seq, no, specifier, names, default_name: two modules near by, one without names, a package and a file that isn't there."""
    n = F.col("seq")
    run, only = F.concat(F.lit("run"), _number(n % 5)), F.concat(F.lit("only"), _number(n + 3))
    specifiers = F.array(
        F.concat(F.lit("../services/billing"), _number(n - 5)),
        F.concat(F.lit("../../packages/core/src/auth/session"), _number(n - 1), F.lit(".ts")),
        F.concat(F.lit("./path"), _number(n), F.lit(".x")),
        F.lit("react"),
        F.concat(F.lit("./util"), _number(n + n % 2)),
    )
    rows = files.select("path", "seq", run.alias("run"), only.alias("only"), F.posexplode(specifiers).alias("no", "specifier"))
    names = F.when(F.col("no") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("save"), F.lit("Store"), F.col("run"), F.col("only"), F.lit("get")))
    return rows.select("path", "seq", "no", "specifier", names.alias("names"), F.when(F.col("no") == 1, "session").alias("default_name"))


def _callers(no: Column, n: Column) -> list[Column]:
    """A function for even numbers, a method for odd ones."""
    even = no % 2 == 0
    return [
        F.when(even, "FUNCTION").otherwise("METHOD").alias("caller_kind"),
        F.when(~even, "Store").alias("caller_owner"),
        F.when(even, F.concat(F.lit("run"), _number(n % 5))).otherwise("save").alias("caller"),
    ]


def calls(files: DataFrame) -> DataFrame:
    """path, seq, no, caller columns, callee, kind, file, owner, symbol, confidence, line: each capitalized word of a text is a call; what it is,
    and how much of its target is known, follows from its length and place."""
    n, no, word = F.col("seq"), F.col("no"), F.col("callee")
    long = F.length(word)
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (at + 1).cast("int"))
    rows = files.select("path", "seq", F.posexplode(F.regexp_extract_all("content", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("no", "callee"))
    symbol = pick(("save", "get", F.concat(F.lit("only"), _number(n + no % 3)), word), long % 4)
    return rows.select(
        "path",
        "seq",
        "no",
        *_callers(no, n),
        "callee",
        pick(KINDS, (long + n + no) % 7).alias("kind"),
        F.when(no % 3 == 0, F.col("path")).when(no % 3 == 1, _path(n + 1)).alias("file"),
        F.when(long % 2 == 0, F.concat(F.lit("Prisma."), word)).otherwise("Store").alias("owner"),
        F.when(no % 11 != 0, symbol).alias("symbol"),
        pick(("HIGH", "LOW", "MEDIUM", "HIGH", "LOW"), no % 5).alias("confidence"),
        (no + 1).cast("int").alias("line"),
    )


def queries(files: DataFrame) -> DataFrame:
    """path, seq, no, caller columns, model, method, orm: each run of nine and more small letters is a query of a model."""
    rows = files.select("path", "seq", F.posexplode(F.regexp_extract_all("content", F.lit("[a-z]{9,}"), F.lit(0))).alias("at", "model"))
    no = F.col("at") + QUERY_FROM
    orm = F.when(F.endswith("path", F.lit(".go")), "gorm").otherwise("prisma")
    return rows.select("path", "seq", no.alias("no"), *_callers(no, F.col("seq")), "model", F.lit("findMany").alias("method"), orm.alias("orm"))


def dependencies(files: DataFrame) -> DataFrame:
    """path, seq, no, owner, type_name: a class of the same name in each file, one that a single file has, one that none has."""
    types = F.array(F.lit("Store"), F.concat(F.lit("Solo"), _number(F.col("seq") + 1)), F.lit("Nowhere"))
    return files.select("path", "seq", F.posexplode(types).alias("at", "type_name")).select("path", "seq", (F.col("at") + DEPENDENCY_FROM).alias("no"), F.lit("Store").alias("owner"), "type_name")


def routes(files: DataFrame) -> DataFrame:
    """id, file, seq, no, framework, method, route, handler columns, confidence: four routes in each file, handled by a function, a method of
    the next file, the file itself and a function that isn't there."""
    n, no = F.col("seq"), F.col("no")
    at = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), no + 1)
    rows = files.select("path", "seq", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("no"))
    route = F.concat(F.lit("/r"), _number(n), F.lit("/"), _number(no))
    return rows.select(
        F.concat(F.lit("API_ROUTE:"), "path", F.lit(":"), _number(no)).alias("id"),
        F.col("path").alias("file"),
        "seq",
        "no",
        F.lit("express").alias("framework"),
        at("GET", "POST", "ALL", "PUT").alias("method"),
        route.alias("route"),
        at("get", "save", "default", "gone").alias("handler_name"),
        F.when(no == 1, "Store").alias("handler_class"),
        F.when(no == 1, _path(n + 1)).alias("handler_file"),
        at("HIGH", "MEDIUM", "LOW", "HIGH").alias("confidence"),
    )
