"""How far an analysis can be trusted, who may see what, and scores against targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.functions.text import round_half_up

#: Precision and recall that relationships of a type should reach.
TARGETS = (
    ("CALLS", 0.9, 0.8),
    ("IMPORTS", 0.95, 0.9),
    ("USES", 0.9, 0.75),
    ("HANDLED_BY", 0.9, 0.85),
    ("QUERIES", 0.85, 0.8),
    ("FETCHES", 0.85, 0.7),
    ("overall", 0.9, 0.8),
)
#: Paths that are no part of a product.
TEST_PATH = r"(?i)(^|/)(__(tests|mocks)__|tests?|spec|fixtures?)/|\.(test|spec)\.[cm]?[jt]sx?$"
DEMO_PATH = r"(?i)(^|/)(examples?|demos?|samples?|playgrounds?|docs(?:-v\d+)?|documentation|www|website|bench(?:mark)?s?|e2e)/"
#: A route on a line, by its verb or after .route().
VERB_ROUTE = r"(?i)\b[A-Za-z_$][\w$]*\s*\.\s*(get|post|put|patch|delete|options|head|all|use)\s*\(\s*(['\"`])(\/[^'\"`]*|\*[^'\"`]*)\2"
CHAINED_ROUTE = r"(?i)\.route\s*\(\s*(['\"`])([^'\"`]+)\1\s*\)\s*\.\s*(get|post|put|patch|delete|all)\s*\("


def trust(health: DataFrame) -> DataFrame:
    """Adds parsed_pct, high_pct and trust to rows (discovered, parsed, failures, unsupported, truncated, signals, high,
    edges)."""
    c = F.col
    infra = (c("discovered") == 0) & (c("signals") > 0)
    part = F.when(c("discovered") > 0, round_half_up(100.0 * c("parsed") / c("discovered")))
    parsed = part.when(infra, F.lit(None)).when(c("parsed") > 0, F.lit(100))
    high = F.when(c("edges") > 0, round_half_up(100.0 * c("high") / c("edges")))
    rows = health.withColumns({"parsed_pct": parsed.cast("long"), "high_pct": high})
    under = lambda name, n: F.coalesce(c(name) < n, F.lit(False))
    broken = c("failures") > F.greatest(F.lit(3), F.floor(c("parsed") * 0.05))
    level = (
        F.when(infra & (c("signals") >= 2) & ~c("truncated"), "HIGH")
        .when(c("truncated") | ((c("discovered") > 0) & under("parsed_pct", 50)), "INCOMPLETE")
        .when(under("parsed_pct", 75) | under("high_pct", 40) | broken, "LOW")
        .when(under("parsed_pct", 95) | under("high_pct", 70) | (c("unsupported") > 2 * c("parsed")) | infra, "MEDIUM")
        .otherwise("HIGH")
    )
    return rows.withColumn("trust", level)


def is_primary(path: Column) -> Column:
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~path.rlike(TEST_PATH) & ~path.rlike(DEMO_PATH)


def _rank(role: Column) -> Column:
    return F.when(role == "admin", 3).when(role == "editor", 2).otherwise(1)


def can_read(visibility: Column, org: Column, creator: Column, login: Column, orgs: Column) -> Column:
    """Whether an actor (login, orgs) may see a view: repository-wide ones always, private ones its creator, those of an
    organization its creator and members."""
    own = F.coalesce(login == creator, F.lit(False))
    member = F.coalesce(F.array_contains(F.transform(orgs, F.lower), F.lower(org)), F.lit(False))
    return F.when(visibility == "repo", True).when(visibility == "private", own).otherwise(org.isNull() | own | member)


def can_write(required: Column, visibility: Column, creator: Column, login: Column, role: Column) -> Column:
    """Whether an actor may change a view: admins always; others with the role it asks for, and private views of somebody
    their creator only; without a login, views of a repository that ask for no role."""
    enough = _rank(role) >= _rank(required)
    open_ = login.isNull() & (visibility == "repo") & (required == "viewer")
    others = (visibility == "private") & login.isNotNull() & creator.isNotNull() & (login != creator)
    return (F.coalesce(role, F.lit("")) == "admin") | (F.coalesce(enough, F.lit(False)) & ~F.coalesce(others, F.lit(False))) | (~enough & open_)


def routes(files: DataFrame) -> DataFrame:
    """(path, line, method, route) of routes that lines of files (path, content) declare, all of a line."""
    lines = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("no", "text"))
    every = lambda p, verb, route: F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(verb)).alias("method"), F.regexp_extract_all("text", F.lit(p), F.lit(route)).alias("route"))
    found = lines.select("path", "no", F.explode(F.concat(every(VERB_ROUTE, 1, 3), every(CHAINED_ROUTE, 3, 2))).alias("r"))
    return found.select("path", (F.col("no") + 1).alias("line"), F.upper("r.method").alias("method"), "r.route")


def attained(scores: DataFrame) -> DataFrame:
    """Scores (type, precision, recall) with the targets of their types, and whether both are reached; a score that can't be
    taken isn't in the way."""
    goals = scores.sparkSession.createDataFrame(TARGETS, "type string, least_precision double, least_recall double")
    reached = lambda c: F.coalesce(F.col(c) >= F.col(f"least_{c}"), F.lit(True))
    return scores.join(F.broadcast(goals), "type").withColumn("attained", reached("precision") & reached("recall"))
