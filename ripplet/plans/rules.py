"""Further queries: rules over paths, text, patches and snapshots, graph building, jobs. They join those of the catalog."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.functions import text as fn
from ripplet.operators import build, checks, diffs, paths, tables
from ripplet.plans.catalog import FILES, FINDINGS, GRAPH, SLASHED, _cases, _edges, _findings, _list, _query, _text
from ripplet.sources import driver_tables as src
from ripplet.streaming import state

IN_SECRET = " or ".join(f"regexp_matches(string_split(path, '/')[-1], {_text(p)}) or regexp_matches(path, {_text(p)})" for p in paths.SECRET_NAMES)
TEST_SQL = f"regexp_matches(regexp_replace({SLASHED}, '^\\./', ''), {_text(paths.TEST_FILE)})"
TYPE_SQL = f"case when {TEST_SQL} then 'TEST' else coalesce({_cases('lower(path)', paths.FILE_TYPES)}, 'FILE') end"


@_query(f"with {FILES} select path, list_has_any(string_split(path, '/'), {_list(paths.IGNORED)}) or {IN_SECRET} as ignored, regexp_matches(path, {_text(paths.CODE_FILE)}) as code, {TEST_SQL} as test, {TYPE_SQL} as type, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') as folder, string_split(path, '/')[-1] as base from files")
def path_roles(spark, sf_dir):
    p = F.col("path")
    marks = {"ignored": paths.ignored(p), "code": paths.is_code(p), "test": paths.is_test_file(p), "type": paths.file_type(p), "folder": paths.folder(p), "base": paths.base(p)}
    return src.files(spark, sf_dir).select(p, *[c.alias(n) for n, c in marks.items()])


ROUTE_SQL = f"""r as (select path, coalesce(nullif(regexp_extract({SLASHED}, '(?:^|/)app/(api/.+)/route\\.(ts|tsx|js|jsx)$', 1), ''),
 regexp_replace(regexp_extract({SLASHED}, '(?:^|/)pages/(api/.+)\\.(ts|tsx|js|jsx)$', 1), '/index$', '')) as found from files)"""
NAMED_SQL = "regexp_replace(regexp_replace(regexp_replace(x, '^\\[\\[\\.\\.\\.(.+)\\]\\]$', ':\\1*'), '^\\[\\.\\.\\.(.+)\\]$', ':\\1*'), '^\\[(.+)\\]$', ':\\1')"


@_query(f"with {FILES}, {ROUTE_SQL} select path, '/' || array_to_string(list_transform(string_split(found, '/'), lambda x: {NAMED_SQL}), '/') as route from r where found <> ''")
def file_routes(spark, sf_dir):
    return src.files(spark, sf_dir).select("path", paths.file_route(F.col("path")).alias("route")).where("route is not null")


@_query(
    f"""with {FILES}, p as (select path, list_filter(string_split(path, '/'), lambda x: x <> '') as s from files)
 select path, case when s[1] in ('packages', 'apps') and s[2] <> '' then s[1] || '/' || s[2] when s[1] = 'cli' then 'cli'
 when s[1] = 'src' then case when s[2] = 'app' and s[3] = 'api' then 'src/app/api' when s[2] in ('app', 'components', 'lib', 'services') then 'src/' || s[2] else 'src' end
 when s[2] <> '' then s[1] || '/' || s[2] when s[1] <> '' then s[1] else 'root' end as root from p"""
)
def module_roots(spark, sf_dir):
    return src.files(spark, sf_dir).select("path", paths.module_root(F.col("path")).alias("root"))


@_query(
    f"""with {FILES}, k as (select {SLASHED} as path, seq from files), m as (select case when string_split(path, '/')[1] in ('packages', 'apps', 'services', 'src') then array_to_string(string_split(path, '/')[1:2], '/') else string_split(path, '/')[1] end as module, seq from k),
 g as (select module, count(*) as n, min(seq) as first from m where module <> '' and module not like '.%' group by module order by n desc, first limit 12) select module, n, {_cases('module', paths.MODULE_ROLES)} as role from g"""
)
def important_modules(spark, sf_dir):
    return paths.important_modules(src.files(spark, sf_dir))


PRESENT = " union all ".join(f"select '{r}' as rule, {SLASHED} as path, seq from files where regexp_matches({SLASHED}, {_text(p)})" for p, r in checks.PATH_RULES)


@_query(f"with {FILES}, h as ({PRESENT}) select rule, arg_min(path, seq) as path from h group by rule")
def presence_findings(spark, sf_dir):
    return paths.first_paths(src.files(spark, sf_dir), checks.PATH_RULES)


@_query(f"with {FILES} select path as file, 'auth_sensitive_change:' || path || ':0:Authentication-sensitive code changed' as id from files where regexp_matches(path, {_text(checks.AUTH_PATH)})")
def auth_changes(spark, sf_dir):
    f = src.files(spark, sf_dir).where(F.col("path").rlike(checks.AUTH_PATH))
    ident = checks.finding_id(F.lit("auth_sensitive_change"), F.col("path"), F.lit(0), F.lit("Authentication-sensitive code changed"))
    return f.select(F.col("path").alias("file"), ident.alias("id"))


def _places(pattern: str, most: str) -> str:
    """Each occurrence with the text up to it, put together again from what matches and what lies between."""
    parted = f"select path, string_split_regex(content, '{pattern}') as parts, regexp_extract_all(content, '{pattern}') as m from files where not {TEST_SQL}"
    return f"select path, unnest(range(1, {most} + 1)) as k, parts, m from ({parted}) where len(m) > 0"


UP_TO = "array_to_string(list_transform(range(1, k + 1), lambda i: parts[i] || case when i < k then m[i] else '' end), '')"
ANY_SQL, CATCH_SQL = _places(r"\bany\b", "least(len(m), 8)"), _places(r"catch\s*\([^)]*\)\s*\{\s*\}", "len(m)")


@_query(
    rf"""with {FILES}, a as ({ANY_SQL}), b as (select path, {UP_TO} as before, coalesce(parts[k + 1] || coalesce(m[k + 1], ''), '') as after from a),
 c as ({CATCH_SQL}), d as (select path, {UP_TO} as before from c)
 select distinct 'unsafe_any' as rule, 'low' as severity, 'Unsafe any usage' as title, path as file, len(string_split(before, chr(10)))::int as line from b where regexp_matches(right(before, 3) || 'any' || after[1:3], ':\s*any\b|as\s+any\b|<any>')
 union all select distinct 'weak_error_handling', 'medium', 'Empty catch block', path, len(string_split(before, chr(10)))::int from d"""
)
def text_findings(spark, sf_dir):
    return checks.text_findings(src.files(spark, sf_dir))


@_query(f"with {FINDINGS}, q as (select * replace (case when rule = 'unsafe_env_handling' then 'quality' else category end as category) from findings) select id, case when category = 'quality' and not starts_with(file, 'src/') then 'info' else severity end as severity from q")
def scoped_findings(spark, sf_dir):
    found = _findings(spark, sf_dir).withColumn("category", F.when(F.col("rule") == "unsafe_env_handling", "quality").otherwise(F.col("category")))
    return checks.scoped(found, src.files(spark, sf_dir).where("path like 'src/%'")).select("id", "severity")


@_query(f"with {FINDINGS} select severity, sum(changed)::bigint as overridden, count(*) as n from (select case rule when 'secret_exposure' then 'high' when 'suspicious_input_handling' then 'high' else severity end as severity, (rule = 'secret_exposure')::int as changed from findings) group by severity")
def severity_overrides(spark, sf_dir):
    found = checks.overridden(_findings(spark, sf_dir), {"secret_exposure": "high", "suspicious_input_handling": "high"})
    return found.groupBy("severity").agg(F.count_if("overridden").alias("overridden"), F.count("*").alias("n"))


ENV_SQL = "env as (select distinct path, unnest(list_concat(regexp_extract_all(content, 'process\\.env\\.([A-Z0-9_]+)', 1), regexp_extract_all(content, 'process\\.env\\[[\"'']([A-Z0-9_]+)[\"'']\\]', 1))) as name from files)"


@_query(f"with {FILES}, {ENV_SQL} select path, list_sort(list(name)) as names from env group by path")
def env_variables(spark, sf_dir):
    return src.env_variables(src.files(spark, sf_dir)).groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names"))


SYMBOLS = f"""symbols as (select path, seq, ['FUNCTION', 'CLASS', 'METHOD', 'FUNCTION'][i + 1] as kind, case i when 2 then 'Store' end as owner,
 ['run' || seq % 5, 'Store', 'save', 'get'][i + 1] as name, seq % 3 <> i % 3 as exported, (1 + (seq + i * 3) % 6)::int as start_line, (1 + (seq + i * 3) % 6 + 2 + (i * seq) % 300)::int as end_line, ((seq * (i + 1)) % 31)::int as complexity
 from files, range(4) t(i))"""


@_query(f"with {FILES}, {SYMBOLS} select rule, severity, path as file, case when kind = 'METHOD' then owner || '.' || name else name end as symbol from (select *, 'large_function' as rule, 'medium' as severity from symbols where kind = 'FUNCTION' and end_line - start_line + 1 >= 80 union all select *, 'large_class', 'medium' from symbols where kind = 'CLASS' and end_line - start_line + 1 >= 250 union all select *, 'high_complexity_function', case when complexity >= 25 then 'high' else 'medium' end from symbols where kind <> 'CLASS' and complexity >= 15) where not {TEST_SQL}")
def size_findings(spark, sf_dir):
    return checks.size_findings(src.symbols(src.files(spark, sf_dir)))


@_query(f"with {FILES}, {SYMBOLS} select name, count(*) as n from symbols where kind = 'FUNCTION' and not {TEST_SQL} group by name having count(*) >= 4 and len(name) >= 3 and not regexp_matches(name, {_text(checks.COMMON_NAMES)})")
def repeated_names(spark, sf_dir):
    return checks.repeated_names(src.symbols(src.files(spark, sf_dir)))


IMPORTS = """imports as (select path, unnest(['./path' || seq || '.x', '../services/billing' || (seq - 5), '../../packages/core/src/auth/session' || (seq - 1) || '.ts', 'react', './util' || (seq + seq % 2)]) as specifier, ['save', 'Store', 'run' || seq % 5] as names from files),
 plain as (select *, regexp_replace(regexp_replace(regexp_replace(replace(coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') || '/' || specifier, '/./', '/'), '[^/]+/\\.\\./', ''), '[^/]+/\\.\\./', ''), '[^/]+/\\.\\./', '') as p from imports),
 tried as (select path, specifier, unnest(range(11)) as ord, unnest([p, p || '.ts', p || '.tsx', p || '.js', p || '.jsx', p || '.mjs', p || '.cjs', p || '/index.ts', p || '/index.tsx', p || '/index.js', p || '/index.jsx']) as c from plain where regexp_matches(specifier, '^[./]')),
 hit as (select path, specifier, arg_min(c, ord) as resolved from tried where c in (select path from files) group by all),
 resolved as (select i.path, i.specifier, i.names, h.resolved from imports i left join hit h using (path, specifier))"""


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = src.files(spark, sf_dir)
    return paths.resolve_imports(src.imports(files), files)


@_query(f"with {FILES}, {IMPORTS} select path, specifier, resolved from resolved")
def import_resolution(spark, sf_dir):
    return _imports(spark, sf_dir).select("path", "specifier", "resolved")


SYMBOL_ID = "case kind when 'METHOD' then 'METHOD:' || path || ':' || owner || '.' || name else kind || ':' || path || ':' || name end"


@_query(
    f"""with {FILES}, {SYMBOLS}, {ENV_SQL} select 'FILE:' || path as id, {TYPE_SQL} as type, string_split(path, '/')[-1] as name, path as file from files
 union all select {SYMBOL_ID}, kind, case kind when 'METHOD' then owner || '.' || name else name end, path from symbols union all select 'ENV_VARIABLE:' || path || ':' || name, 'ENV_VARIABLE', name, path from env"""
)
def graph_nodes(spark, sf_dir):
    files = src.files(spark, sf_dir)
    return build.build_nodes(files, src.symbols(files), src.env_variables(files))


@_query(
    f"""with {FILES}, {SYMBOLS}, {ENV_SQL}, {IMPORTS}, known as (select distinct path, kind, name from symbols where kind <> 'METHOD'),
 named as (select distinct path, resolved, unnest(names) as name from resolved where resolved is not null),
 uses as (select n.path, coalesce((select max(kind) from known k where k.path = n.resolved and k.name = n.name) || ':' || n.resolved || ':' || n.name, (select min(kind || ':' || path || ':' || name) from known k where k.name = n.name having count(*) = 1)) as dst,
  exists (select 1 from known k where k.path = n.resolved and k.name = n.name) as here from named n)
 select 'FILE:' || path as src, {SYMBOL_ID} as dst, 'CONTAINS' as type, 'HIGH' as confidence from symbols
 union select 'CLASS:' || path || ':' || owner, {SYMBOL_ID}, 'CONTAINS', 'HIGH' from symbols where kind = 'METHOD'
 union select 'FILE:' || path, {SYMBOL_ID}, 'EXPORTS', 'HIGH' from symbols where kind <> 'METHOD' and exported
 union select 'FILE:' || path, 'ENV_VARIABLE:' || path || ':' || name, 'READS', 'HIGH' from env
 union select 'FILE:' || path, 'FILE:' || resolved, 'IMPORTS', 'HIGH' from resolved where resolved is not null and path <> resolved
 union select 'FILE:' || path, 'FILE:' || resolved, 'TESTS', 'HIGH' from resolved where resolved is not null and path <> resolved and {TEST_SQL}
 union select 'FILE:' || path, dst, 'USES', case when here then 'HIGH' else 'MEDIUM' end from uses where dst is not null"""
)
def graph_edges(spark, sf_dir):
    files, imports = src.files(spark, sf_dir), _imports(spark, sf_dir)
    symbols, env = src.symbols(files), src.env_variables(files)
    parts = (build.contained(symbols, env), build.imported(imports), build.tested(files, imports), build.used(imports, symbols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


KINDS = ("METHOD", "CLASS", "FUNCTION", "EXTERNAL", "MODULE", "QUERY", "UNRESOLVED")


@_query(
    f"""with {FILES}, c as (select seq, {_list(KINDS)}[seq % 7 + 1] as kind, case when seq % 3 > 0 then path end as file, case when seq % 2 = 0 then 'Prisma.User' else 'Store' end as owner, case when seq % 5 > 0 then 'save' end as symbol from files)
 select seq, case kind when 'UNRESOLVED' then null when 'EXTERNAL' then 'EXTERNAL_SERVICE:' || coalesce(symbol, file, 'http') when 'MODULE' then 'FILE:' || file
 when 'QUERY' then case when starts_with(owner, 'Prisma.') then 'DATABASE_MODEL:' || coalesce(file, 'prisma') || ':' || owner[8:] end
 else case when file is not null and symbol is not null then case kind when 'METHOD' then 'METHOD:' || file || ':' || owner || '.' || symbol when 'CLASS' then 'CLASS:' || file || ':' || symbol else 'FUNCTION:' || file || ':' || symbol end end end as target from c"""
)
def call_targets(spark, sf_dir):
    n = F.col("seq")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (n % 7 + 1).cast("int"))
    call = F.struct(kind.alias("kind"), F.when(n % 3 > 0, F.col("path")).alias("file"), F.when(n % 2 == 0, "Prisma.User").otherwise("Store").alias("owner"), F.when(n % 5 > 0, "save").alias("symbol"))
    return src.files(spark, sf_dir).select("seq", call.alias("c")).select("seq", build.call_target().alias("target"))


@_query(f"with {FILES}, s as (select unnest(['apps/web', 'apps', 'packages/core/src', 'packages', 'src']) as root, unnest(['web', 'apps', 'core', 'packages', 'main']) as system) select path, arg_max(system, len(root)) as system from files, s where starts_with(path, root || '/') group by path")
def file_systems(spark, sf_dir):
    systems = spark.createDataFrame([("apps/web", "web"), ("apps", "apps"), ("packages/core/src", "core"), ("packages", "packages"), ("src", "main")], "root string, system string")
    return paths.nearest_prefix(src.files(spark, sf_dir), systems)


PATCH = f"""patches as (select path, seq, 'diff --git' || chr(10) || '@@ -' || (seq % 9 + 1) || ',6 +' || (seq % 7 + 1) || ',7 @@' || chr(10) || array_to_string(list_transform(range(10), lambda k: case when k = 5 then '@@ -' || (40 + seq % 5) || ' +' || (50 + seq % 3) || ' @@ fn' else [' ', '+', '-', '+'][(seq + k) % 4 + 1] || {_list(src.CODE)}[(seq * 3 + k * 2) % {len(src.CODE)} + 1] end), chr(10)) as patch,
 ['modified', 'added', 'modified', 'renamed', null][seq % 5 + 1] as status from files)"""
LINES_SQL = f"""l as (select path, unnest(string_split(patch, chr(10))) as text, generate_subscripts(string_split(patch, chr(10)), 1) as no from patches), m as (select *, regexp_matches(text, {_text(diffs.HUNK)}) as hunk from l),
 h as (select *, sum(hunk::int) over (partition by path order by no) as h from m),
 s as (select *, max(case when hunk then regexp_extract(text, {_text(diffs.HUNK)}, 1)::int end) over (partition by path, h) as old0, max(case when hunk then regexp_extract(text, {_text(diffs.HUNK)}, 2)::int end) over (partition by path, h) as new0 from h where h > 0),
 b as (select *, starts_with(text, '+') as a, starts_with(text, '-') as c, starts_with(text, ' ') or text = '' as same from s where not hunk and not regexp_matches(text, {_text(diffs.HEADER)})),
 n as (select path, a, c, new0 + coalesce(sum((a or same)::int) over w, 0) as new, old0 + coalesce(sum((c or same)::int) over w, 0) as old from b window w as (partition by path, h order by no rows between unbounded preceding and 1 preceding)),
 changed as (select path, 'new' as side, new as line from n where (a or c) and new > 0 union select path, 'old', old from n where c and old > 0)"""


@_query(f"with {FILES}, {PATCH}, {LINES_SQL} select path, side, line::bigint as line from changed")
def changed_lines(spark, sf_dir):
    return diffs.changed_lines(src.patches(src.files(spark, sf_dir))).withColumn("line", F.col("line").cast("long"))


@_query(f"with {FILES}, {PATCH}, {LINES_SQL}, {SYMBOLS} select c.path, c.line::bigint as line, arg_min(s.name, (case s.kind when 'METHOD' then 0 when 'FUNCTION' then 1 else 2 end, s.end_line - s.start_line, s.start_line, s.name)) as name from changed c join symbols s on s.path = c.path and c.line between s.start_line and s.end_line where side = 'new' group by all")
def enclosing_symbols(spark, sf_dir):
    files = src.files(spark, sf_dir)
    lines = diffs.changed_lines(src.patches(files)).where("side = 'new'").select("path", F.col("line").cast("long").alias("line"))
    return diffs.enclosing(lines, src.symbols(files)).select("path", "line", "name")


NAMES_SQL = " union ".join(f"select path, regexp_extract(text, {_text(p)}, 1) as name from l" for p in diffs.DECLARED)


@_query(f"with {FILES}, {PATCH}, l as (select path, unnest(string_split(patch, chr(10))) as text from patches), f as ({NAMES_SQL}) select path, name from f where name <> '' and not list_contains({_list(diffs.NO_NAMES)}, name)")
def changed_names(spark, sf_dir):
    return diffs.changed_names(src.patches(src.files(spark, sf_dir)))


@_query(f"with {FILES}, {PATCH} select path, case when status in ('removed', 'renamed', 'added') then 'STRUCTURAL' when regexp_matches(patch, {_text(diffs.CONFIGURES)}) then 'CONFIGURATION' when regexp_matches(patch, {_text(diffs.DECLARES)}) then 'INTERFACE' when regexp_matches(patch, '{diffs.MOVES}') then 'STRUCTURAL' else 'BEHAVIORAL' end as kind from patches")
def change_kinds(spark, sf_dir):
    return src.patches(src.files(spark, sf_dir)).select("path", diffs.change_kind(F.col("patch"), F.col("status")).alias("kind"))


@_query("with o as (select o_custkey as repository, l_suppkey as system, row_number() over (partition by o_custkey order by o_orderkey) as r, l_orderkey from orders join lineitem on o_orderkey = l_orderkey), a as (select distinct repository, system from o join (select o_custkey, min(o_orderkey) as k from orders group by 1) on repository = o_custkey and l_orderkey = k), b as (select distinct repository, system from o join (select o_custkey, max(o_orderkey) as k from orders group by 1) on repository = o_custkey and l_orderkey = k) select *, 'added' as change from (select * from b except select * from a) union all select *, 'removed' from (select * from a except select * from b)")
def system_changes(spark, sf_dir):
    orders, items = src.table(spark, sf_dir, "orders"), src.table(spark, sf_dir, "lineitem")
    ends = orders.groupBy(F.col("o_custkey").alias("repository")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    of = lambda end: items.join(ends, F.col("l_orderkey") == F.col(end)).select("repository", F.col("l_suppkey").alias("system"))
    return diffs.set_changes(of("lo"), of("hi"), ["repository", "system"])


CODES = ("NETWORK_ERROR", "EMPTY_REPOSITORY", "ODD", "ANALYSIS_TIMEOUT")


@_query(
    f"""with j as (select event_id, {_list(CODES)}[event_id % 4 + 1] as code, case event_id % 7 when 0 then 500 when 1 then 429 when 2 then 404 end as status from events)
 select event_id, coalesce(status >= 500 or status = 429, false) or list_contains({_list(state.RETRYABLE)}, code) as retryable, coalesce(status in (401, 403, 404), false) or list_contains({_list(state.DETERMINISTIC)}, code) as deterministic from j"""
)
def failure_kinds(spark, sf_dir):
    n = F.col("event_id")
    code = F.element_at(F.array(*map(F.lit, CODES)), (n % 4 + 1).cast("int"))
    status = F.when(n % 7 == 0, 500).when(n % 7 == 1, 429).when(n % 7 == 2, 404)
    return src.table(spark, sf_dir, "events").select(n, state.is_retryable(code, status).alias("retryable"), state.is_deterministic(code, status).alias("deterministic"))


STATES = ("received", "queued", "processing", "completed", "failed")


@_query(f"with e as (select event_id // 4 as delivery, ts, event_id, {_list(STATES)}[event_id % 5 + 1] as status from events) select delivery, status, case when status in ('completed', 'failed') then ts end as processed_at from e qualify row_number() over (partition by delivery order by ts desc, event_id desc) = 1")
def delivery_states(spark, sf_dir):
    n = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, STATES)), (n % 5 + 1).cast("int"))
    return state.delivery_states(src.table(spark, sf_dir, "events").select(F.floor(n / 4).alias("delivery"), "ts", n, status.alias("status")))


JOB_STATES = ("QUEUED", "RUNNING", "RETRYING", "SUCCEEDED", "DEAD_LETTER")
JOBS = f"jobs as (select o_orderkey as job, {_list((*JOB_STATES, 'FAILED'))}[o_orderkey % 6 + 1] as status, (o_orderkey % 4)::int as attempts, o_orderdate::timestamp as updated_at from orders)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (*JOB_STATES, "FAILED"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    o = src.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("job"), status.alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))


@_query(f"with {JOBS} select " + ", ".join(f"count(*) filter (where status = '{s}') as {s.lower()}" for s in JOB_STATES) + " from jobs")
def queue_depth(spark, sf_dir):
    return state.queue_depth(_jobs(spark, sf_dir))


@_query(f"with {JOBS} select job, case when job % 3 = 0 and status = 'DEAD_LETTER' then 'QUEUED' else status end as status, case when job % 3 = 0 and status = 'DEAD_LETTER' then 0 else attempts end as attempts from jobs")
def dead_letter_retry(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return state.retried(jobs, jobs.where("job % 3 = 0")).select("job", "status", "attempts")


NOW = datetime.datetime(1998, 1, 1)


@_query(f"with {JOBS} select job, status from jobs where not (status in ('SUCCEEDED', 'DEAD_LETTER') and updated_at < timestamp '1998-01-01' - interval 14 day)")
def job_retention(spark, sf_dir):
    return state.retained(_jobs(spark, sf_dir), F.lit(NOW)).select("job", "status")


@_query("with a as (select o_custkey as repository, (o_orderkey % 2)::varchar as sha, o_orderkey as id, (o_orderkey % 3)::int as version, o_orderdate::timestamp as updated_at, case when o_orderkey % 7 > 0 then o_orderdate::timestamp + interval 300 day end as expires_at from orders) select repository, sha, id from a where version = 1 and (expires_at is null or expires_at > timestamp '1998-01-01') qualify row_number() over (partition by repository, sha order by updated_at desc, id desc) = 1")
def analysis_cache(spark, sf_dir):
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    expires = F.when(k % 7 > 0, at + F.make_dt_interval(F.lit(300)))
    rows = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repository"), (k % 2).cast("string").alias("sha"), k.alias("id"), (k % 3).cast("int").alias("version"), at.alias("updated_at"), expires.alias("expires_at"))
    return state.cached(rows, F.lit(NOW), 1).select("repository", "sha", "id")


@_query("select event_type as name, 'page=' || (event_id % 3) || ',user=' || (user_id % 2) as labels, sum(event_id % 11)::bigint as value from events group by all")
def metric_counters(spark, sf_dir):
    n, u = F.col("event_id"), (F.col("user_id") % 2).cast("string")
    page = (n % 3).cast("string")
    labels = F.when(n % 2 == 0, F.create_map(F.lit("user"), u, F.lit("page"), page)).otherwise(F.create_map(F.lit("page"), page, F.lit("user"), u))
    return state.counters(src.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), labels.alias("labels"), (n % 11).alias("value")))


#: The types of expected edges that kinds of events stand for.
EDGE_KINDS = {"view": "CALLS", "click": "IMPORTS", "signup": "USES", "error": "HANDLED_BY", "purchase": "QUERIES"}
KIND_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EDGE_KINDS.items()) + " else 'FETCHES' end"
CLASSES = ("TRUE_POSITIVE", "FALSE_POSITIVE", "MISSING_EDGE", "WRONG_TARGET", "WRONG_TYPE", "LOW_CONFIDENCE", "TRUE_POSITIVE", "TRUE_POSITIVE")


@_query(
    f"""with r as (select {KIND_SQL} as type, {_list(CLASSES)}[(event_id // 3) % 8 + 1] as class, event_id % 5 = 0 as soft from events), b as (select type, class, soft from r union all select 'overall', class, soft from r),
 s as (select type, count(*) filter (where not soft and class = 'TRUE_POSITIVE') as tp, count(*) filter (where not soft and class = 'FALSE_POSITIVE') as fp, count(*) filter (where not soft and class in ('MISSING_EDGE', 'WRONG_TARGET', 'WRONG_TYPE')) as fn, count(*) filter (where not soft and class = 'LOW_CONFIDENCE') as low,
 count(*) filter (where soft and class in ('MISSING_EDGE', 'WRONG_TARGET', 'WRONG_TYPE', 'LOW_CONFIDENCE')) as soft_misses from b group by type)
 select *, floor(tp / nullif(tp + fp, 0) * 1000 + 0.5) / 1000 as precision, floor((tp + low) / nullif(tp + low + fn, 0) * 1000 + 0.5) / 1000 as recall from s"""
)
def relationship_scores(spark, sf_dir):
    n = F.col("event_id")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in EDGE_KINDS.items() for x in pair])[F.col("event_type")], F.lit("FETCHES"))
    found = F.element_at(F.array(*map(F.lit, CLASSES)), (F.floor(n / 3) % 8 + 1).cast("int"))
    return tables.relationship_scores(src.table(spark, sf_dir, "events").select(kind.alias("type"), found.alias("class"), (n % 5 == 0).alias("soft")))


@_query("select o_custkey as repository_id, max(o_orderkey) as last_run, count(*) as runs, count(*) filter (where o_orderstatus = 'F') as failed from orders group by 1 order by case when o_custkey % 9 = 0 then null else max(o_orderdate) end desc nulls first, o_custkey limit 8")
def recent_repositories(spark, sf_dir):
    k = F.col("o_custkey")
    row = src.table(spark, sf_dir, "orders").groupBy(k.alias("repository_id")).agg(F.max("o_orderkey").alias("last_run"), F.count("*").alias("runs"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.max("o_orderdate").alias("at"))
    analyzed = F.when(F.col("repository_id") % 9 != 0, F.col("at"))
    return row.orderBy(analyzed.desc_nulls_first(), "repository_id").limit(8).drop("at")


@_query(GRAPH + ", p as (select e.*, a.type as src_type, b.type as dst_type from edges e join nodes a on e.src = a.id join nodes b on e.dst = b.id) select src_type, dst_type, count(*) as n from p where src_type <> dst_type group by all")
def cross_system_edges(spark, sf_dir):
    nodes = src.nodes(spark, sf_dir)
    return tables.cross_counts(_edges(spark, sf_dir), nodes)


@_query(
    f"""with {FILES}, {SYMBOLS}, {IMPORTS}, used as (select resolved as path, unnest(names) as name from resolved where resolved is not null
 union select resolved, string_split(resolved, '/')[-1] from resolved where resolved <> path union select resolved, string_split(string_split(resolved, '/')[-1], '.')[-1] from resolved where resolved <> path)
 select 'unused_export' as rule, 'low' as severity, 'Possibly unused export' as title, path as file, start_line as line, name as symbol from symbols s where kind = 'FUNCTION' and exported and not {TEST_SQL}
 and not exists (select 1 from used u where u.path = s.path and u.name = s.name)"""
)
def unused_exports(spark, sf_dir):
    files = src.files(spark, sf_dir)
    symbols, found = src.symbols(files), _imports(spark, sf_dir)
    nodes = build.build_nodes(files, symbols, src.env_variables(files))
    calls = found.where("resolved is not null").select(F.col("resolved").alias("file"), F.explode("names").alias("symbol"))
    return checks.unused_exports(symbols, nodes, build.imported(found), calls)
