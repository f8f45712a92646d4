"""Impact of a change: severity, score, tests that are related or missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of names and files that mark sensitive areas.
SENSITIVE = ("auth", "payment", "billing", "security", "migration", "deploy", "session", "password", "token", "permission", "rbac")


def sensitive(name: Column, file: Column) -> Column:
    text = F.lower(F.concat(name, F.lit(" "), file))
    out = F.lit(False)
    for hint in SENSITIVE:
        out = out | F.contains(text, F.lit(hint))
    return out


def severity(depth: Column, is_sensitive: Column) -> Column:
    return F.when((depth == 0) | (is_sensitive & (depth <= 2)), "CRITICAL").when(depth == 1, "HIGH").when(depth == 2, "MEDIUM").otherwise("NEUTRAL")


def level(score: Column) -> Column:
    return F.when(score >= 70, "Critical").when(score >= 45, "Elevated").when(score >= 20, "Moderate").otherwise("Low")


def is_api(kind: Column, name: Column, file: Column) -> Column:
    return (kind == "API_ROUTE") | file.rlike("(?i)route|controller|api/") | F.lower(name).rlike("route|controller")


def is_test(kind: Column, file: Column) -> Column:
    return (kind == "TEST") | file.contains(".test.") | file.contains(".spec.")


def impacted(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Found nodes (id, depth) with their columns and severity."""
    joined = found.join(nodes, "id")
    return joined.withColumn("severity", severity(F.col("depth"), sensitive(F.col("name"), F.col("file"))))


def report(hit: DataFrame, missing: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: counts, complexity score (at most 100) and level; only changed nodes and direct impacts make it sensitive."""
    api = is_api(F.col("type"), F.col("name"), F.col("file"))
    near = (F.col("depth") <= 1) & sensitive(F.col("name"), F.col("file"))
    row = hit.agg(
        F.count_if(F.col("depth") == 0).alias("changed"),
        F.count_if(F.col("depth") == 1).alias("direct"),
        F.count_if(F.col("depth") > 1).alias("indirect"),
        F.count_if(api).alias("apis"),
        F.count_distinct("file").alias("files"),
        F.coalesce(F.bool_or(near), F.lit(False)).alias("is_sensitive"),
    )
    row = row.crossJoin(missing.agg(F.count("*").alias("gaps"))).crossJoin(tests.agg(F.count("*").alias("tests")))  # one row each
    bonus = F.when(F.col("is_sensitive"), 15).otherwise(0)
    points = 4 * F.col("changed") + 3 * F.col("direct") + F.col("indirect") + 5 * F.col("apis") + 6 * F.col("gaps") + bonus
    return row.withColumn("score", F.least(F.lit(100), points).cast("long")).withColumn("level", level(F.col("score")))


def related_tests(hit: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id) of the tests among the impacted nodes, and of the nodes with a TESTS edge (src, dst, type) to a changed node or its file."""
    own = hit.where(is_test(F.col("type"), F.col("file"))).select("id")
    changed = hit.where("depth = 0")
    aims = changed.select("id").union(changed.select(F.concat(F.lit("FILE:"), "file"))).distinct()
    into = edges.where("type = 'TESTS'").join(aims.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return own.union(into.join(nodes.select("id"), "id", "left_semi")).distinct()


def missing_tests(hit: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """Direct impacts, tests aside, to which or to whose file no related test has an edge (src, dst) of any type."""
    covered = edges.join(tests.withColumnRenamed("id", "src"), "src", "left_semi").select("dst").distinct()
    direct = hit.where((F.col("depth") == 1) & ~is_test(F.col("type"), F.col("file")))
    left = direct.join(covered.withColumnRenamed("dst", "id"), "id", "left_anti")
    by_file = covered.select(F.col("dst").alias("file_id"))
    return left.withColumn("file_id", F.concat(F.lit("FILE:"), "file")).join(by_file, "file_id", "left_anti").select("id", "name", "file")


def explain(found: DataFrame) -> DataFrame:
    """(id, hop, src, dst, type): the edges along the path of each found node (with types, see graph.reached), by the first edge of
    each pair. A path has its types with it, so no edge is looked up again."""
    steps = F.arrays_zip(F.slice("path", F.lit(2), F.size("path")).alias("src"), F.slice("path", F.lit(1), F.size("path") - 1).alias("dst"), F.col("types").alias("type"))
    return found.select("id", F.posexplode(steps).alias("hop", "s")).select("id", "hop", "s.src", "s.dst", "s.type")


#: Nodes whose paths tell most.
TELLING = ("API_ROUTE", "CONTROLLER", "COMPONENT")


def why(hit: DataFrame) -> DataFrame:
    """The impacted node (with path and order) that explains a change best: a telling one, indirect before direct, in the
    order they were found; else the first with a path."""
    telling = F.col("type").isin(*TELLING) | F.col("name").rlike("(?i)login|admin|auth|payment")
    able = hit.where("depth > 0").where(telling | (F.size("path") > 1))
    best = F.struct((~telling).alias("late"), (F.col("depth") <= 1).alias("direct"), "depth", "order")
    return able.agg(F.min_by(F.struct("id", "name", "path"), best).alias("w")).where("w is not null").select("w.*")


def change_seeds(changed: DataFrame, symbols: DataFrame, most: int = 12) -> DataFrame:
    """(path, id) of what changed files (path) stand for: their symbols (path, id) if there are 1 to `most`, else the file."""
    held = changed.join(symbols.groupBy("path").agg(F.count("*").alias("n")), "path", "left")
    few = F.coalesce(F.col("n").between(1, most), F.lit(False))
    files = held.where(~few).select("path", F.concat(F.lit("FILE:"), "path").alias("id"))
    return held.where(few).select("path").join(symbols, "path").select("path", "id").union(files)
