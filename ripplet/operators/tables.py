"""Aggregates, windows and set operations over findings, files, history and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.functions.text import first_label, language, round_half_up

SEVERITIES = ("critical", "high", "medium", "low", "info")


def language_mix(files: DataFrame) -> DataFrame:
    """Files by language, with whole percents of the files that have one."""
    counts = files.select(language(F.col("path")).alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select("language", "n", round_half_up(100.0 * F.col("n") / F.col("total")).alias("pct"))  # a row for each of eight labels


#: Names of kinds of files, the first that fits; others are named by their extension.
KINDS = (
    (r"(?i)^Dockerfile|docker-compose", "Docker"),
    (r"(?i)\.tf$", "Terraform (HCL)"),
    (r"(?i)\.ya?ml$", "YAML"),
    (r"(?i)\.md$", "Markdown"),
    (r"(?i)\.(json|lib)sonnet$", "Jsonnet"),
    (r"(?i)\.py$", "Python"),
    (r"(?i)\.go$", "Go"),
    (r"(?i)\.rs$", "Rust"),
    (r"(?i)\.java$", "Java"),
    (r"(?i)\.rb$", "Ruby"),
    (r"(?i)\.lua$", "Lua"),
    (r"(?i)\.sql$", "SQL"),
    (r"(?i)\.(ts|tsx)$", "TypeScript"),
    (r"(?i)\.(js|jsx|mjs|cjs)$", "JavaScript"),
)
#: Kinds that tell nothing.
NOISE = r"(?i)^(lock|png|jpg|jpeg|gif|webp|ico|woff2?|ttf|map)$"


def kind(path: Column) -> Column:
    """A path's kind: a name of KINDS, or its extension in lower case, or "other"."""
    base = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    extension = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    return F.coalesce(first_label(base, KINDS), F.when(extension == "", "other").otherwise(extension))


def kind_groups(files: DataFrame, parsed: DataFrame, examples: int = 3, most: int = 8) -> DataFrame:
    """Files (path, seq) that weren't parsed (path): count and first paths of each kind, the largest first; equal counts
    stand by their first file."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    other = files.select(path.alias("path"), "seq").join(parsed, "path", "left_anti").where(~F.col("path").rlike(r"(^|/)\.git/"))
    other = other.withColumn("kind", kind(F.col("path"))).where(~F.col("kind").rlike(NOISE))
    top = other.groupBy("kind").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").limit(most)
    ranked = other.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("seq"))).where(F.col("r") <= examples)
    paths = F.transform(F.array_sort(F.collect_list(F.struct("seq", "path"))), lambda x: x.path)
    shown = ranked.groupBy("kind").agg(F.array_join(paths, ",").alias("examples"))
    return top.join(shown, "kind", "left").select("kind", "n", F.coalesce("examples", F.lit("")).alias("examples"))


def pivot_findings(findings: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Findings (category, severity) by category, a column for each severity; categories without any have zeros."""
    grid = findings.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    counts = findings.groupBy("category").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return grid.join(counts, "category", "left").select("category", *[F.coalesce(s, F.lit(0)).alias(s) for s in SEVERITIES])


def severity_rank(c: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for i, s in enumerate(SEVERITIES):
        out = out.when(c == s, i)
    return out


def rule_rollup(findings: DataFrame, most: int = 6) -> DataFrame:
    """Each rule's findings and the title of the first of the worst; the worst rules first."""
    rank = severity_rank(F.col("severity"))
    rolled = findings.groupBy("rule").agg(F.count("*").alias("n"), F.min(rank).alias("worst"), F.min_by("title", F.struct(rank, F.col("seq"))).alias("title"), F.min("seq").alias("first"))
    return rolled.orderBy("worst", "first").limit(most).select("rule", "n", "worst", "title")


def suppress(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings that no ignore rule (rule or *, pattern: a regex of paths) matches. A rule without a pattern matches all of its
    findings, one with a pattern none without a file. The findings' rules are known to be few: rules for each of them and for
    all are joined by the finding's rule, whose size is checked by Spark before it is broadcast."""
    named = findings.select(F.col("rule").alias("of")).distinct()
    wide = rules.alias("i").join(named, (F.col("i.rule") == F.col("of")) | (F.col("i.rule") == "*")).groupBy("of")
    patterns = wide.agg(F.bool_or(F.coalesce("pattern", F.lit("")) == "").alias("all"), F.collect_set("pattern").alias("patterns"))
    held = findings.join(patterns, findings["rule"] == patterns["of"], "left")
    hit = F.coalesce("all", F.lit(False)) | F.coalesce(F.exists("patterns", lambda p: F.rlike(F.col("file"), p)), F.lit(False))
    return held.where(~hit).select(*findings.columns)


def configured(findings: DataFrame, rules: DataFrame, severities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a configuration makes of findings: those that stay, with the severities (rule, severity) it gives to rules; and one row
    of numbers, suppressed and overridden. Severities that aren't known change nothing."""
    kept = suppress(findings, rules)
    new = severities.where(F.col("severity").isin(*SEVERITIES)).select("rule", F.col("severity").alias("__new")).dropDuplicates(["rule"])
    told = kept.join(new, "rule", "left").withColumn("__changed", F.coalesce(F.col("__new") != F.col("severity"), F.lit(False)))
    counts = told.agg(F.count("*").alias("kept"), F.count_if("__changed").alias("overridden"))
    numbers = findings.agg(F.count("*").alias("n")).crossJoin(counts)  # one row each
    stay = told.withColumn("severity", F.coalesce("__new", "severity")).select(*findings.columns)
    return stay, numbers.select((F.col("n") - F.col("kept")).alias("suppressed"), "overridden")


def failed_jobs(jobs: DataFrame, most: int = 50) -> DataFrame:
    """The jobs (job, status, updated_at, ...) that failed or are dead letters, newest first."""
    return jobs.where(F.col("status").isin("FAILED", "DEAD_LETTER")).orderBy(F.desc("updated_at"), "job").limit(most)


def summary(files: DataFrame, symbols: DataFrame, nodes: DataFrame, edges: DataFrame, routes: DataFrame) -> DataFrame:
    """One row of a repository's numbers: files (path, is_test), symbols (kind), IMPORTS edges, tests, and routes: as many as
    were found or as the graph has nodes of, whichever are more."""
    counts = [
        files.agg(F.count("*").alias("files"), F.count_if("is_test").alias("tests")),
        symbols.agg(F.count_if(F.col("kind") == "FUNCTION").alias("functions"), F.count_if(F.col("kind") == "CLASS").alias("classes")),
        edges.agg(F.count_if(F.col("type") == "IMPORTS").alias("dependencies")),
        nodes.agg(F.count_if(F.col("type") == "API_ROUTE").alias("__nodes")),
        routes.agg(F.count("*").alias("__routes")),
    ]
    row = counts[0]
    for c in counts[1:]:
        row = row.crossJoin(c)  # one row each
    return row.withColumn("api_routes", F.greatest("__nodes", "__routes")).drop("__nodes", "__routes")


def latest(history: DataFrame) -> DataFrame:
    """The newest run of each repository."""
    rest = [c for c in history.columns if c != "repository_id"]
    return history.groupBy("repository_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "run_id")).alias("r")).select("repository_id", "r.*")


#: What two snapshots of a repository are compared by.
MEASURES = ("files", "functions", "classes", "dependencies", "tests", "api_routes", "graph_nodes", "graph_edges")


def deltas(history: DataFrame) -> DataFrame:
    """Each run against the one before in its repository: the change of every measure, and the verdict on the blast radius
    by twice the change of direct impacts plus that of indirect ones; null for a first run. A repository's runs are sorted
    in one task, as each is compared with its neighbour."""
    w = Window.partitionBy("repository_id").orderBy("created_at", "run_id")
    delta = lambda c: F.col(c) - F.lag(c).over(w)
    moved = history.select("repository_id", "run_id", *[delta(m).alias(f"d_{m}") for m in MEASURES], delta("direct").alias("d_direct"), delta("indirect").alias("d_indirect"))
    score = 2 * F.col("d_direct") + F.col("d_indirect")
    return moved.withColumn("verdict", F.when(score > 0, "increased").when(score < 0, "decreased").when(score == 0, "unchanged"))


def sparkline(history: DataFrame) -> DataFrame:
    """First, last, largest (at least 1) and difference of each repository's series."""
    key = F.struct("created_at", "run_id")
    row = history.groupBy("repository_id").agg(F.min_by("impact", key).alias("first"), F.max_by("impact", key).alias("last"), F.greatest(F.max("impact"), F.lit(1)).alias("top"))
    return row.withColumn("delta", F.col("last") - F.col("first"))


def new_runs(history: DataFrame, incoming: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Incoming runs that history hasn't, by keys of which the first is the repository; nulls are equal to nulls. A run that has
    none of the other keys (no sha at all) is never held to be known."""
    on = F.coalesce(*[incoming[k].cast("string") for k in keys[1:]]).isNotNull()
    for k in keys:
        on = on & incoming[k].eqNullSafe(history[k])
    return incoming.join(history, on, "left_anti")


def capped(rows: DataFrame, by: str, order: str, each: int, most: int) -> DataFrame:
    """The first `each` rows of a kind, and the first `most` of those."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).drop("r").orderBy(order).limit(most)


def metric_summary(samples: DataFrame, last: int = 500) -> DataFrame:
    """Count, rounded mean and nearest-rank 95th percentile of each metric's newest samples (name, value, seq)."""
    w = Window.partitionBy("name").orderBy(F.desc("seq"))
    recent = samples.withColumn("r", F.row_number().over(w)).where(F.col("r") <= last)
    ordered = recent.groupBy("name").agg(F.count("*").alias("n"), round_half_up(F.avg("value")).alias("avg"), F.array_sort(F.collect_list("value")).alias("v"))
    return ordered.select("name", "n", "avg", F.element_at("v", F.least(F.col("n"), F.floor(0.95 * F.col("n")) + 1).cast("int")).alias("p95"))


def precision_recall(scored: DataFrame) -> DataFrame:
    """Of rows (truth, hit): counts, precision, recall, F1 and accuracy (hits of all that was there or was found); null where a denominator is zero."""
    row = scored.agg(F.count_if(F.col("truth") & F.col("hit")).alias("tp"), F.count_if(~F.col("truth") & F.col("hit")).alias("fp"), F.count_if(F.col("truth") & ~F.col("hit")).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    accuracy = F.try_divide("tp", F.col("tp") + F.col("fp") + F.col("fn"))
    f1 = F.try_divide(2 * p * r, p + r)
    return row.select("tp", "fp", "fn", *[F.round(c, 3).alias(n) for n, c in (("precision", p), ("recall", r), ("f1", f1), ("accuracy", accuracy))])


def stable_sample(rows: DataFrame, by: str, key: str, each: int, seed: str) -> DataFrame:
    """The rows of each kind whose seeded sha256 comes first."""
    w = Window.partitionBy(by).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key)), 256))
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).drop("r")


def relationship_scores(rows: DataFrame) -> DataFrame:
    """Of classified relationships (type, class, soft): scores of each type and of all. Soft rows only count as misses; an
    edge of low confidence counts as found for recall."""
    hard = lambda *names: F.count_if(~F.col("soft") & F.col("class").isin(*names))
    missed = ("MISSING_EDGE", "WRONG_TARGET", "WRONG_TYPE")
    both = rows.select(F.explode(F.array(F.col("type"), F.lit("overall"))).alias("type"), "class", "soft")
    counts = both.groupBy("type").agg(
        hard("TRUE_POSITIVE").alias("tp"),
        hard("FALSE_POSITIVE").alias("fp"),
        hard(*missed).alias("fn"),
        hard("LOW_CONFIDENCE").alias("low"),
        F.count_if(F.col("soft") & F.col("class").isin(*missed, "LOW_CONFIDENCE")).alias("soft_misses"),
    )
    third = lambda c: F.floor(c * 1000 + 0.5) / 1000
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp") + F.col("low"), F.col("tp") + F.col("low") + F.col("fn"))
    return counts.withColumns({"precision": third(precision), "recall": third(recall)})


def cross_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes of different types, by both types. Those of one type that lead to one node are counted before its type
    is looked up."""
    of = lambda end: nodes.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type"))
    led = edges.select("src", "dst").join(of("src"), "src").groupBy("dst", "src_type").agg(F.count("*").alias("n"))
    return led.join(of("dst"), "dst").where("src_type <> dst_type").groupBy("src_type", "dst_type").agg(F.sum("n").alias("n"))
