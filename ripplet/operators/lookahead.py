"""Routes whose handler stands somewhere after what declares them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.operators.checks import occurrences

#: A decorator with a route, a path in its arguments, its methods; what a handler, and what else ends the search.
DECORATOR = r"(?i)^\s*@([A-Za-z_]\w*)\s*\.\s*(get|post|put|patch|delete|options|head|route|api_route)\s*\((.*)\)\s*$"
QUOTED = r"['\"]([^'\"]+)['\"]"
METHODS = r"(?i)methods\s*=\s*\[([^\]]*)\]"
METHOD = r"(?i)['\"](GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)['\"]"
HANDLER = r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("
OTHER = r"^\s*(?:class|def|async\s+def)\b"
LINES = 11
#: A mapping (its verb, its path), a method after it, a class before it, and how far the method may be.
MAPPING = r"@(Get|Post|Put|Patch|Delete|Request)Mapping\s*(?:\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"'][^)]*\))?"
JVM_METHOD = r"\b(?:public|protected|private)\s+(?:static\s+)?(?:[\w.<>\[\]]+)\s+(\w+)\s*\("
JVM_CLASS = r"\bclass\s+(\w+)"
REACH = 400


def slashed(path: Column) -> Column:
    """A route's path with a slash before it."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def decorator_routes(files: DataFrame) -> DataFrame:
    """(path, line, method, route, handler, confidence) of the decorators in files (path, content) that declare routes; a row for each
    method. The handler is the first function within eleven lines, of which other decorators are passed over and anything else
    that begins a function or class ends the search: a window of eleven lines, no join. With a handler the confidence is HIGH.
    Decorators without a path are left out; null texts have none."""
    lines = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("no", "text"))
    name = F.nullif(F.regexp_extract("text", HANDLER, 1), F.lit(""))
    mark = F.when(~F.col("text").rlike(r"^\s*@") & (name.isNotNull() | F.col("text").rlike(OTHER)), F.struct(name.alias("name")))
    after = Window.partitionBy("path").orderBy("no").rowsBetween(1, LINES)
    found = lines.withColumn("next", F.first(mark, ignorenulls=True).over(after)).where(F.col("text").rlike(DECORATOR))
    verb, said = F.lower(F.regexp_extract("text", DECORATOR, 2)), F.regexp_extract("text", DECORATOR, 3)
    route = F.nullif(F.regexp_extract(said, QUOTED, 1), F.lit(""))
    listed = F.transform(F.regexp_extract_all(F.regexp_extract(said, METHODS, 1), F.lit(METHOD), F.lit(1)), F.upper)
    methods = F.when(~verb.isin("route", "api_route"), F.array(F.upper(verb))).when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("ALL")))
    handler = F.col("next.name")
    sure = F.when(handler.isNotNull(), "HIGH").otherwise("MEDIUM")
    rows = found.select("path", (F.col("no") + 1).alias("line"), F.explode(methods).alias("method"), slashed(route).alias("route"), handler.alias("handler"), sure.alias("confidence"))
    return rows.where("route is not null")


def mapping_routes(files: DataFrame) -> DataFrame:
    """(path, line, method, route, handler, class) of the mappings in files (path, seq, content). The handler is the first method within
    400 characters after a mapping, which the pattern looks at without taking them; the class is the file's first, if it stands
    before the mapping. Both are null if there is none; a mapping without a path is of /."""
    whole = f"{MAPPING}(?=([\\s\\S]{{0,{REACH}}}))"
    rows = occurrences(files, whole, groups={"verb": 1, "route": 2, "after": 3})
    first = files.select("path", "seq", F.regexp_extract("content", JVM_CLASS, 1).alias("class"), (F.regexp_instr("content", F.lit(JVM_CLASS)) - 1).alias("at"), F.length(F.regexp_extract("content", JVM_CLASS, 0)).alias("long"))
    some = lambda c: F.nullif(c, F.lit(""))
    held = rows.join(first.where("at >= 0"), ["path", "seq"], "left")
    before = F.when(F.col("at") + F.col("long") <= F.col("start"), F.col("class"))
    verb = F.when(F.col("verb") == "Request", "ALL").otherwise(F.upper("verb"))
    return held.select("path", "line", verb.alias("method"), slashed(F.col("route")).alias("route"), some(F.regexp_extract("after", JVM_METHOD, 1)).alias("handler"), before.alias("class"))
