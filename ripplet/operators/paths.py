"""Rules over the paths of a repository: what is ignored, what a file is, which route or module it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.functions.text import first_label

#: Folders that are never read, and names that may hold secrets.
IGNORED = ("node_modules", "vendor", "dist", "build", "coverage", ".cache", ".next", ".nuxt", ".turbo", ".git", "out", "tmp", "__pycache__", ".venv", "venv")
SECRET_NAMES = (r"^\.env($|\.)", r"\.pem$", r"\.key$", r"(?i)credentials\.json$", "id_rsa", "(?i)secret")
#: Extensions of source files; what marks a test.
CODE_FILE = r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|java|rs|cs)$"
TEST_FILE = r"\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)$|/__tests__/|/tests/|/test/"
#: Types of file nodes by a path in lower case, the first that fits; tests come before.
FILE_TYPES = (
    ("controller", "CONTROLLER"),
    ("service", "SERVICE"),
    (r"\.(tsx|jsx)$|/components/", "COMPONENT"),
    ("/hooks/", "HOOK"),
    ("route|/api/", "API_ROUTE"),
    ("model|schema|entity", "DATABASE_MODEL"),
    ("config", "CONFIG"),
)
#: Roles of modules, the first that fits.
MODULE_ROLES = (
    (r"^apps/|(?i:frontend|web|ui|client)", "Application"),
    (r"^packages/|(?i:lib|shared|core)", "Library / package"),
    (r"(?i)api|server|backend|service", "Service"),
    (r"(?i)test", "Tests"),
    (r"(?i)infra|deploy|ops|k8s|terraform|helm|guestbook|kustomize|applicationset|sock-shop|manifest", "Infrastructure"),
)


def slashed(path: Column) -> Column:
    """With forward slashes, without ./ at the start."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """What stands before the last slash, "." if there is none."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(F.contains(path, F.lit("/")), found).otherwise(F.lit("."))


def ignored(path: Column) -> Column:
    out = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED)))
    for pattern in SECRET_NAMES:
        out = out | base(path).rlike(pattern) | path.rlike(pattern)
    return out


def is_code(path: Column) -> Column:
    return path.rlike(CODE_FILE)


def is_test_file(path: Column) -> Column:
    return slashed(path).rlike(TEST_FILE)


def file_type(path: Column) -> Column:
    return F.when(is_test_file(path), "TEST").otherwise(F.coalesce(first_label(F.lower(path), FILE_TYPES), F.lit("FILE")))


def _named(segment: Column) -> Column:
    """A segment in brackets as a parameter of a route."""
    many = F.regexp_replace(segment, r"^\[\[\.\.\.(.+)\]\]$|^\[\.\.\.(.+)\]$", ":$1$2*")
    return F.regexp_replace(many, r"^\[(.+)\]$", ":$1")


def file_route(path: Column) -> Column:
    """The url that a file stands for by its place (app/api/.../route or pages/api/...); null for other files."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    app = F.regexp_extract(path, r"(?:^|/)app/(api/.+)/route\.(ts|tsx|js|jsx)$", 1)
    page = F.regexp_replace(F.regexp_extract(path, r"(?:^|/)pages/(api/.+)\.(ts|tsx|js|jsx)$", 1), "/index$", "")
    found = F.when(app != "", app).otherwise(page)
    return F.when(found != "", F.concat(F.lit("/"), F.array_join(F.transform(F.split(found, "/"), _named), "/")))


def module_root(path: Column) -> Column:
    """The part of a path that names its module."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    two = F.concat_ws("/", at(0), at(1))
    src = (
        F.when((at(1) == "app") & (at(2) == "api"), "src/app/api")
        .when(at(1).isin("app", "components", "lib", "services"), two)
        .otherwise("src")
    )
    out = F.when(at(0).isin("packages", "apps") & (at(1) != ""), two).when(at(0) == "cli", "cli").when(at(0) == "src", src)
    return out.when(at(1) != "", two).when(at(0) != "", at(0)).otherwise("root")


def important_modules(files: DataFrame, most: int = 12) -> DataFrame:
    """Files (path, seq) by module: the largest first, equal ones by their first file, with a role."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    one = F.substring_index(path, "/", 1)
    key = F.when(one.isin("packages", "apps", "services", "src"), F.substring_index(path, "/", 2)).otherwise(one)
    counts = files.select(key.alias("module"), "seq").where("module <> '' and module not like '.%'").groupBy("module")
    top = counts.agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").limit(most)
    return top.select("module", "n", first_label(F.col("module"), MODULE_ROLES).alias("role"))


def glob_pattern(glob: str) -> str:
    """A pattern for paths: ** is any text, **/ any folders, * and ? stay inside a folder; a glob without these is a path
    or a folder above it."""
    glob = glob.replace("\\", "/").removeprefix("./")
    quoted = lambda x: "".join("\\" + c if c in ".+^${}()|[]\\" else c for c in x)
    if not set(glob) & set("*?"):
        return f"^{quoted(glob.removesuffix('/'))}(/.*)?$"
    out = quoted(glob)
    for mark, pattern in (("**/", "\0"), ("**", "\1"), ("*", "[^/]*"), ("?", "[^/]"), ("\0", "(?:.*/)?"), ("\1", ".*")):
        out = out.replace(mark, pattern)
    return f"^{out}$"


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Adds resolved to imports (path, specifier): the first file there is among the forms that a relative specifier may
    stand for; null for other specifiers. Files are told by what they may be called, which is three forms at most, so one join
    with a row for each import does, whatever the number of forms."""
    endings = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
    whole = F.concat(folder(F.col("path")), F.lit("/"), F.col("specifier"))
    step = lambda done, x: (
        F.when(x.isin("", "."), done)
        .when((x == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
        .otherwise(F.array_append(done, x))
    )
    plain = F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")
    path = F.col("path")
    called = [F.when(F.endswith(path, F.lit(e)), F.struct(F.left(path, F.length(path) - len(e)).alias("__plain"), F.lit(i).alias("ord"))) for i, e in enumerate(endings)]
    forms = files.select("path", F.explode(F.array_compact(F.array(*called))).alias("f"))
    known = forms.groupBy(F.col("f.__plain").alias("__plain")).agg(F.min(F.struct("f.ord", F.col("path").alias("resolved"))).alias("r")).select("__plain", "r.resolved")
    # Other specifiers meet nothing; each has a key of its own path, so that they don't all go to one task as nulls would.
    relative = F.col("specifier").rlike(r"^[./]")
    rows = imports.withColumns({"__relative": F.coalesce(relative, F.lit(False)), "__at": F.when(relative, plain).otherwise(path)})
    met = rows.join(known, F.col("__relative") & (F.col("__at") == F.col("__plain")), "left")
    return met.select("path", "specifier", *[c for c in imports.columns if c not in ("path", "specifier")], "resolved")


def nearest_prefix(files: DataFrame, systems: DataFrame) -> DataFrame:
    """(path, system) by the longest folder of a path that a system (root, system) has."""
    parts = F.split("path", "/")
    roots = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    tried = files.select("path", F.explode(roots).alias("root")).join(systems, "root")
    return tried.groupBy("path").agg(F.max_by("system", F.length("root")).alias("system"))


def first_paths(files: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """(rule, path): the first file (path, seq) that each rule's pattern is found in; backslashes of a path are slashes."""
    files = files.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "seq")
    hits = F.explode(F.array_compact(F.array(*[F.when(F.col("path").rlike(p), F.lit(r)) for p, r in rules])))
    ranked = files.select("path", "seq", hits.alias("rule"))
    w = Window.partitionBy("rule").orderBy("seq")
    return ranked.withColumn("r", F.row_number().over(w)).where("r <= 1").select("rule", "path")
