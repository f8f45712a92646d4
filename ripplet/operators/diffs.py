"""Unified patches: changed lines, changed symbols, kinds of change; and sets that differ between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A hunk's header, and lines of a patch that are a file's headers.
HUNK = r"^@@\s+-(\d+)(?:,\d+)?\s+\+(\d+)(?:,\d+)?\s+@@"
HEADER = r"^(\+\+\+|---|diff |similarity |rename )"
#: A declaration on a changed line, and words that are none.
DECLARED = (
    r"^[+-]\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_][\w$]*)",
    r"^[+-]\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_][\w$]*)\s*=",
    r"^[+-]\s*(?:export\s+)?class\s+([A-Za-z_][\w$]*)",
    r"^[+-]\s*(?:export\s+)?(?:interface|type)\s+([A-Za-z_][\w$]*)",
    r"^[+-]\s+(?:public\s+|private\s+|protected\s+|async\s+|static\s+)*(?:async\s+)?([A-Za-z_][\w$]*)\s*\(",
)
NO_NAMES = ("if", "for", "while", "switch", "catch", "return", "await", "typeof")
#: What a patch holds if it changes configuration, an interface, or the structure.
CONFIGURES = r"(?i)process\.env|Dockerfile|docker-compose|\.ya?ml|terraform|\.env"
DECLARES = r"[+-]\s*(?:export\s+)?(?:async\s+)?function\s+\w+\s*\([^)]*\)|[+-]\s*(?:export\s+)?(?:interface|type|class)\s+\w+|[+-].*\([^)]*\)\s*:\s*\w+"
MOVES = "deleted file mode|new file mode|rename from|rename to"


def patch_keys(patches: DataFrame) -> list[str]:
    """What tells patches apart: their path, and their change if they have one."""
    return [c for c in ("change", "path") if c in patches.columns]


def patch_lines(patches: DataFrame) -> DataFrame:
    """([change,] path, no, text) of each line of patches ([change,] path, patch)."""
    return patches.select(*patch_keys(patches), F.posexplode(F.split("patch", "\r?\n")).alias("no", "text"))


def changed_lines(patches: DataFrame) -> DataFrame:
    """([change,] path, side, line): the numbers of changed lines; side new or old. A line that goes counts on the new side too,
    as the one that stands there now. Numbers run on within a hunk, by sums over the lines of one patch."""
    keys = patch_keys(patches)
    lines = patch_lines(patches).withColumn("hunk", F.col("text").rlike(HUNK))
    place = Window.partitionBy(*keys).orderBy("no")
    held = lines.withColumn("h", F.sum(F.col("hunk").cast("int")).over(place)).where("h > 0")
    start = lambda k: F.max(F.when(F.col("hunk"), F.regexp_extract("text", HUNK, k).cast("int")))
    one = Window.partitionBy(*keys, "h")
    here = held.withColumns({"old0": start(1).over(one), "new0": start(2).over(one)}).where(~F.col("hunk") & ~F.col("text").rlike(HEADER))
    add, cut = F.startswith("text", F.lit("+")), F.startswith("text", F.lit("-"))
    same = F.startswith("text", F.lit(" ")) | (F.col("text") == "")
    before = Window.partitionBy(*keys, "h").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0))
    at = here.select(*keys, add.alias("add"), cut.alias("cut"), (F.col("new0") + count(add | same)).alias("new"), (F.col("old0") + count(cut | same)).alias("old"))
    side = lambda when, name: F.when(when & (F.col(name) > 0), F.struct(F.lit(name).alias("side"), F.col(name).alias("line")))
    sides = F.array_compact(F.array(side(F.col("add") | F.col("cut"), "new"), side(F.col("cut"), "old")))
    return at.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.side", "s.line").distinct()


def changed_names(patches: DataFrame) -> DataFrame:
    """(path, name) of what is declared on changed lines, by patterns."""
    found = F.array(*[F.regexp_extract("text", p, 1) for p in DECLARED])
    names = patch_lines(patches).select("path", F.explode(found).alias("name"))
    return names.where((F.col("name") != "") & ~F.col("name").isin(*NO_NAMES)).distinct()


def change_kind(patch: Column, status: Column) -> Column:
    return (
        F.when(F.coalesce(status, F.lit("")).isin("removed", "renamed", "added"), "STRUCTURAL")
        .when(F.coalesce(patch, F.lit("")) == "", "BEHAVIORAL")
        .when(patch.rlike(CONFIGURES), "CONFIGURATION")
        .when(patch.rlike(DECLARES), "INTERFACE")
        .when(patch.rlike(MOVES), "STRUCTURAL")
        .otherwise("BEHAVIORAL")
    )


def enclosing(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """([change,] path, line, name): the smallest symbol ([change,] path, kind, name, start_line, end_line) about a line; methods
    come before functions, and these before classes. Joined by file, with the interval as a condition; a column owner, if
    there is one, and kind are kept."""
    inside = (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))
    rank = F.when(F.col("kind") == "METHOD", 0).when(F.col("kind") == "FUNCTION", 1).otherwise(2)
    keys = patch_keys(lines)
    held = lines.join(symbols, keys).where(inside)
    best = F.struct(rank, F.col("end_line") - F.col("start_line"), F.col("start_line"), F.col("name"))
    kept = ["name", *[c for c in ("kind", "owner") if c in symbols.columns]]
    return held.groupBy(*keys, "line").agg(F.min_by(F.struct(*kept), best).alias("s")).select(*keys, "line", "s.*")


def set_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that only one of two snapshots has, with change: added or removed."""
    added = new.select(*keys).distinct().join(old, keys, "left_anti").withColumn("change", F.lit("added"))
    removed = old.select(*keys).distinct().join(new, keys, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)
