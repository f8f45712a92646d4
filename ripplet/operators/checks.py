"""Findings in source text, and what a change or a configuration makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.operators.paths import is_test_file

#: Fixed values: (rule, severity, title, length of the evidence, patterns that a line holds, pattern that it doesn't hold).
PLACEHOLDER = r"(?i)your[_-]?api[_-]?key|changeme|xxx+|placeholder|example\.com|TODO"
LINE_RULES = (
    (
        "unsafe_env_handling",
        "medium",
        "Environment secret with literal default",
        160,
        (r"process\.env\.[A-Z0-9_]+", r"fallback|default.*=.*['\"]", r"['\"][^'\"]{12,}['\"]", r"(?i)secret|token|key|password"),
        None,
    ),
    (
        "secret_exposure",
        "critical",
        "Hard-coded credential assignment",
        120,
        (r"(?i)(?:api[_-]?key|secret|token|password|passwd|private[_-]?key)\s*[:=]\s*['\"][^'\"]{8,}['\"]",),
        PLACEHOLDER,
    ),
    ("secret_exposure", "critical", "Private key material in source", 120, (r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",), PLACEHOLDER),
    (
        "secret_exposure",
        "critical",
        "GitHub personal access token pattern",
        120,
        (r"ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}",),
        PLACEHOLDER,
    ),
    ("secret_exposure", "critical", "AWS access key id pattern", 120, (r"AKIA[0-9A-Z]{16}",), PLACEHOLDER),
    ("secret_exposure", "critical", "Slack token pattern", 120, (r"xox[baprs]-[0-9A-Za-z-]{10,}",), PLACEHOLDER),
    (
        "suspicious_input_handling",
        "high",
        "User input reaches a dangerous sink",
        160,
        (r"\b(req|request)\.(body|query|params)\b", r"\beval\s*\(|new Function\s*\(|child_process|execSync|exec\("),
        None,
    ),
)
#: What is looked for in a whole text: (rule, severity, title, pattern, how many occurrences of a file are looked at,
#: what has to stand about one).
TEXT_RULES = (
    ("unsafe_any", "low", "Unsafe any usage", r"\bany\b", 8, r":\s*any\b|as\s+any\b|<any>"),
    ("weak_error_handling", "medium", "Empty catch block", r"catch\s*\([^)]*\)\s*\{\s*\}", None, None),
)
#: Rules by path, (pattern, rule).
PATH_RULES = (
    (r"(^|/)\.github/workflows/", "github_actions_present"),
    (r"(?i)(^|/)Dockerfile(\.|$)|docker-compose", "docker_present"),
    (r"(?i)(^|/)(?:k8s|kubernetes|manifests)/|(?:deployment|service|ingress).*\.ya?ml$", "kubernetes_present"),
    (r"(?i)(^|/)charts?/|Chart\.ya?ml$", "helm_changed"),
    (r"(?i)\.tf$|(^|/)terraform/", "terraform_present"),
    (r"(?i)argocd", "argocd_changed"),
)
#: Paths that have to do with signing in.
AUTH_PATH = r"(?i)auth|session|jwt|password|oauth"
#: Function names that say nothing when they repeat.
COMMON_NAMES = r"(?i)^(handler|run|main|init|setup|test|get|set)$"


def finding_id(rule: Column, file: Column, line: Column, name: Column) -> Column:
    return F.concat_ws(":", rule, F.coalesce(file, F.lit("repo")), F.coalesce(line, F.lit(0)).cast("string"), name)


def line_findings(files: DataFrame) -> DataFrame:
    """The findings of LINE_RULES in files (path, seq, content), in the order of files, lines and rules."""
    lines = files.select("path", "seq", F.posexplode(F.split("content", "\r?\n")).alias("no", "text"))
    found = []
    for i, (rule, severity, title, most, held, never) in enumerate(LINE_RULES):
        hit = F.lit(True)
        for pattern in held:
            hit = hit & F.col("text").rlike(pattern)
        if never:
            hit = hit & ~F.col("text").rlike(never)
        what = [F.lit(x).alias(n) for n, x in (("rule", rule), ("severity", severity), ("title", title))]
        found.append(F.when(hit, F.struct(F.lit(i).alias("i"), *what, F.substring(F.trim("text"), 1, most).alias("evidence"))))
    rows = lines.select("path", "seq", "no", F.explode(F.array_compact(F.array(*found))).alias("f"))
    line, name = (F.col("no") + 1).alias("line"), F.col("f.title")
    ident = finding_id(F.col("f.rule"), F.col("path"), F.col("no") + 1, name).alias("id")
    order = (F.col("seq") * 1_000_000_000 + F.col("no") * 10 + F.col("f.i")).alias("seq")
    return rows.select(ident, "f.rule", F.lit("security").alias("category"), "f.severity", "f.title", F.col("path").alias("file"), line, "f.evidence", order)


def occurrences(files: DataFrame, pattern: str, most: int | None = None, groups: dict[str, int] | None = None) -> DataFrame:
    """(path, seq, k, line, start, around) of the first `most` occurrences of a pattern in files (path, seq, content), all without it:
    line is one more than the line feeds before an occurrence, start the characters before it; around begins three characters before
    it and ends three after. groups names columns for groups of the pattern ("" where one took no part).

    A text is parted once into what matches and what lies between; the line feeds of both are added up by a window over a file's
    occurrences, so the work is in proportion to the text however many there are.
    """
    between, found = F.split("content", pattern), F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    taken = {name: F.regexp_extract_all("content", F.lit(pattern), F.lit(i)) for name, i in (groups or {}).items()}
    texts = files.select("path", "seq", between.alias("between"), found.alias("found"), *[c.alias(f"g_{n}") for n, c in taken.items()]).where(F.size("found") > 0)
    empty = F.array(F.lit(""))
    n = F.size("found")
    zipped = F.arrays_zip(
        F.slice("between", F.lit(1), n).alias("before"),
        F.col("found").alias("hit"),
        F.concat(empty, F.slice("found", F.lit(1), n - 1)).alias("last"),
        F.slice("between", F.lit(2), n).alias("after"),
        F.concat(F.slice("found", F.lit(2), n), empty).alias("next"),
        *[F.col(f"g_{name}").alias(f"g_{name}") for name in taken],
    )
    each = texts.select("path", "seq", F.posexplode(zipped if most is None else F.slice(zipped, 1, most)).alias("k", "o"))
    before = F.concat("o.last", "o.before")
    ahead = Window.partitionBy("path", "seq").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    line, start = F.sum(F.regexp_count(before, F.lit("\n"))).over(ahead) + 1, F.sum(F.length(before)).over(ahead)
    around = F.concat(F.right(F.concat("o.last", "o.before"), F.lit(3)), F.col("o.hit"), F.left(F.concat("o.after", "o.next"), F.lit(3)))
    names = [F.col(f"o.g_{name}").alias(name) for name in taken]
    return each.select("path", "seq", "k", line.cast("int").alias("line"), start.cast("long").alias("start"), around.alias("around"), *names)


def text_findings(files: DataFrame) -> DataFrame:
    """rule, severity, title, file, line of the findings of TEXT_RULES in files (path, seq, content); tests are left out."""
    out = None
    for rule, severity, title, pattern, most, around in TEXT_RULES:
        rows = occurrences(files.where(~is_test_file(F.col("path"))), pattern, most)
        if around:
            rows = rows.where(F.col("around").rlike(around))
        rows = rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.col("path").alias("file"), "line")
        out = rows if out is None else out.unionByName(rows)
    return out.dropDuplicates(["rule", "file", "line"])


def scoped(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings for a change: quality findings in files (path) that didn't change become info."""
    hit = findings.join(changed.select(F.col("path").alias("file"), F.lit(True).alias("__hit")).distinct(), "file", "left")
    lower = F.col("file").isNotNull() & F.col("__hit").isNull() & (F.col("category") == "quality")
    return hit.withColumn("severity", F.when(lower, "info").otherwise(F.col("severity"))).drop("__hit")


def overridden(findings: DataFrame, severities: dict[str, str]) -> DataFrame:
    """Findings with the severities that a configuration gives to rules; overridden tells which changed."""
    new = F.create_map(*[F.lit(x) for pair in severities.items() for x in pair])[F.col("rule")]
    changed = F.coalesce(new != F.col("severity"), F.lit(False))
    return findings.withColumns({"overridden": changed, "severity": F.coalesce(new, F.col("severity"))})


def repeated_names(symbols: DataFrame, least: int = 4) -> DataFrame:
    """Function names (name) of three letters and more that stand `least` times in files other than tests."""
    counts = symbols.where((F.col("kind") == "FUNCTION") & ~is_test_file(F.col("path"))).groupBy("name").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= least) & (F.length("name") >= 3) & ~F.col("name").rlike(COMMON_NAMES))


def size_findings(symbols: DataFrame) -> DataFrame:
    """Large functions (80 lines) and classes (250), and functions and methods of high complexity (15, 25), in
    files other than tests. A method is named with its class before it."""
    lines = F.col("end_line") - F.col("start_line") + 1
    large = F.when((F.col("kind") == "FUNCTION") & (lines >= 80), "large_function").when((F.col("kind") == "CLASS") & (lines >= 250), "large_class")
    many = F.when((F.col("kind") != "CLASS") & (F.col("complexity") >= 15), "high_complexity_function")
    high = F.when(F.col("complexity") >= 25, "high").otherwise("medium")
    both = F.array_compact(
        F.array(F.when(large.isNotNull(), F.struct(large.alias("rule"), F.lit("medium").alias("severity"))), F.when(many.isNotNull(), F.struct(many.alias("rule"), high.alias("severity"))))
    )
    name = F.when(F.col("kind") == "METHOD", F.concat_ws(".", "owner", "name")).otherwise(F.col("name")).alias("symbol")
    rows = symbols.where(~is_test_file(F.col("path"))).select("path", name, F.explode(both).alias("f"))
    return rows.select("f.rule", "f.severity", F.col("path").alias("file"), "symbol")


def unused_exports(symbols: DataFrame, nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """rule, severity, title, file, line, symbol of exported functions (symbols: path, kind, name, exported, start_line) in files other
    than tests that nothing is known to use: no call (file, symbol) resolves to one, and no IMPORTS or CALLS edge (src, dst, type)
    leads from a file to a node (id, name, file) of its name, or of its last part. Other edges don't count."""
    led = edges.where(F.col("type").isin("IMPORTS", "CALLS") & F.startswith("src", F.lit("FILE:"))).select(F.col("dst").alias("id")).distinct()
    aims = nodes.join(led, "id", "left_semi").where("file is not null and name <> ''")
    names = F.array("name", F.element_at(F.split("name", r"\."), -1))
    used = aims.select(F.col("file").alias("path"), F.explode(names).alias("name")).unionByName(calls.where("file is not null and symbol <> ''").select(F.col("file").alias("path"), F.col("symbol").alias("name")))
    own = symbols.where((F.col("kind") == "FUNCTION") & F.col("exported") & ~is_test_file(F.col("path")))
    left = own.join(used.distinct(), ["path", "name"], "left_anti")
    fixed = {"rule": "unused_export", "severity": "low", "title": "Possibly unused export"}
    return left.select(*[F.lit(v).alias(k) for k, v in fixed.items()], F.col("path").alias("file"), F.col("start_line").alias("line"), F.col("name").alias("symbol"))
