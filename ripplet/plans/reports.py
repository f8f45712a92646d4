"""Queries for reports: trust, access, routes, explanations, lists. They join those of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.operators import checks, coverage, graph, impact, lookahead, paths, tables
from ripplet.plans.catalog import FILES, FINDINGS, GRAPH, HISTORY, REACH, SLASHED, _edges, _findings, _found, _query, _seed, _text
from ripplet.plans.rules import JOBS, KIND_SQL, PRESENT, SYMBOL_ID, SYMBOLS, TEST_SQL, _jobs, relationship_scores
from ripplet.sources import driver_tables as src
from ripplet.sources.scratch import written

HEALTH = """health as (select c_custkey as id, c_custkey % 40 as discovered, least(c_custkey % 40, c_custkey % 37) as parsed, c_custkey % 5 as failures, c_custkey % 90 as unsupported, c_custkey % 11 = 0 as truncated, c_custkey % 4 as signals,
 c_custkey % 50 as high, c_custkey % 50 + c_custkey % 13 + c_custkey % 3 as edges from customer),
 p as (select *, case when discovered > 0 then floor(100.0 * parsed / discovered + 0.5)::bigint when signals > 0 then null when parsed > 0 then 100 end as parsed_pct, case when edges > 0 then floor(100.0 * high / edges + 0.5)::bigint end as high_pct, discovered = 0 and signals > 0 as infra from health)"""


@_query(
    f"""with {HEALTH} select id, parsed_pct, high_pct, case when infra and signals >= 2 and not truncated then 'HIGH' when truncated or (discovered > 0 and coalesce(parsed_pct < 50, false)) then 'INCOMPLETE'
 when coalesce(parsed_pct < 75, false) or coalesce(high_pct < 40, false) or failures > greatest(3, floor(parsed * 0.05)) then 'LOW'
 when coalesce(parsed_pct < 95, false) or coalesce(high_pct < 70, false) or unsupported > 2 * parsed or infra then 'MEDIUM' else 'HIGH' end as trust from p"""
)
def coverage_trust(spark, sf_dir):
    k = F.col("c_custkey")
    named = {"discovered": k % 40, "parsed": F.least(k % 40, k % 37), "failures": k % 5, "unsupported": k % 90, "truncated": k % 11 == 0, "signals": k % 4, "high": k % 50, "edges": k % 50 + k % 13 + k % 3}
    rows = src.table(spark, sf_dir, "customer").select(k.alias("id"), *[c.alias(n) for n, c in named.items()])
    return coverage.trust(rows).select("id", "parsed_pct", "high_pct", "trust")


VIEWS = """v as (select c_custkey as id, ['repo', 'private', 'org'][c_custkey % 3 + 1] as visibility, case when c_custkey % 5 > 0 then 'Org' || c_custkey % 4 end as org, case when c_custkey % 7 > 0 then 'u' || c_custkey % 6 end as creator,
 case when c_custkey % 4 > 0 then 'u' || c_custkey % 5 end as login, ['org' || c_custkey % 3, 'ORG9'] as orgs, ['viewer', 'editor', 'admin'][c_custkey % 8 % 3 + 1] as required, case when c_custkey % 10 > 0 then ['viewer', 'editor', 'admin'][c_custkey % 11 % 3 + 1] end as role from customer),
 r as (select *, case role when 'admin' then 3 when 'editor' then 2 else 1 end >= case required when 'admin' then 3 when 'editor' then 2 else 1 end as enough from v)"""


@_query(
    f"""with {VIEWS} select id, case when visibility = 'repo' then true when visibility = 'private' then coalesce(login = creator, false) else org is null or coalesce(login = creator, false) or coalesce(list_contains(list_transform(orgs, lambda o: lower(o)), lower(org)), false) end as can_read,
 coalesce(role = 'admin', false) or (enough and not coalesce(visibility = 'private' and login is not null and creator is not null and login <> creator, false)) or (not enough and login is null and visibility = 'repo' and required = 'viewer') as can_write from r"""
)
def view_access(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    v = src.table(spark, sf_dir, "customer").select(
        k.alias("id"),
        pick(k, "repo", "private", "org").alias("visibility"),
        F.when(k % 5 > 0, text("Org", k % 4)).alias("org"),
        F.when(k % 7 > 0, text("u", k % 6)).alias("creator"),
        F.when(k % 4 > 0, text("u", k % 5)).alias("login"),
        F.array(text("org", k % 3), F.lit("ORG9")).alias("orgs"),
        pick(k % 8, "viewer", "editor", "admin").alias("required"),
        F.when(k % 10 > 0, pick(k % 11, "viewer", "editor", "admin")).alias("role"),
    )
    c = F.col
    read = coverage.can_read(c("visibility"), c("org"), c("creator"), c("login"), c("orgs"))
    write = coverage.can_write(c("required"), c("visibility"), c("creator"), c("login"), c("role"))
    return v.select("id", read.alias("can_read"), write.alias("can_write"))


@_query(f"with {FILES} select path from files where not regexp_matches({SLASHED}, {_text(coverage.TEST_PATH)}) and not regexp_matches({SLASHED}, {_text(coverage.DEMO_PATH)})")
def primary_sources(spark, sf_dir):
    return src.files(spark, sf_dir).select("path").where(coverage.is_primary(F.col("path")))


def _quoted(quote: str) -> str:
    """Routes between two quotes of one kind, on lines l."""
    q = quote.replace("'", "''")
    verb = rf"(?i)\b[A-Za-z_$][\w$]*\s*\.\s*(get|post|put|patch|delete|options|head|all|use)\s*\(\s*{q}([/*][^''\"`]*){q}"
    chained = rf"(?i)\.route\s*\(\s*{q}([^''\"`]+){q}\s*\)\s*\.\s*(get|post|put|patch|delete|all)\s*\("
    pick = lambda pattern, k: f"unnest(regexp_extract_all(text, '{pattern}', {k}))"
    return f"select path, line, {pick(verb, 1)} as method, {pick(verb, 2)} as route from l union all select path, line, {pick(chained, 2)}, {pick(chained, 1)} from l"


@_query(
    f"""with {FILES}, l as (select path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from files),
 r as ({" union all ".join(map(_quoted, ("'", '"', "`")))}) select path, line::int as line, upper(method) as method, route from r"""
)
def express_routes(spark, sf_dir):
    return coverage.routes(src.files(spark, sf_dir))


@_query(REACH.rstrip() + ", s as (select id, unnest(range(len(path) - 1)) as hop, path from found), h as (select id, hop, path[hop + 2] as src, path[hop + 1] as dst from s), t as (select src, dst, arg_min(type, seq) as type from edges group by src, dst) select id, hop::int as hop, src, dst, type from h left join t using (src, dst)")
def explain_path(spark, sf_dir):
    pairs = written(graph.pairs(_edges(spark, sf_dir), typed=True).where("live"), "pairs")
    return impact.explain(graph.reached(_seed(spark, sf_dir), pairs, 3)).select("id", "hop", "src", "dst", "type")


@_query(REACH.rstrip() + ", w as (select n.id, n.name, f.path, f.depth, f.ord, n.type in ('API_ROUTE', 'CONTROLLER', 'COMPONENT') or regexp_matches(n.name, '(?i)login|admin|auth|payment') as telling from f3 f join nodes n using (id) where f.depth > 0) select id, name, array_to_string(path, ' > ') as path from w where telling or len(path) > 1 order by not telling, depth <= 1, depth, ord limit 1")
def why_path(spark, sf_dir):
    hit = _found(spark, sf_dir).join(src.nodes(spark, sf_dir), "id")
    return impact.why(hit).select("id", "name", F.array_join("path", " > ").alias("path"))


@_query(f"with {FILES}, {SYMBOLS}, s as (select path, {SYMBOL_ID} as id from symbols where exported and seq % 4 > 0), n as (select path, count(*) as n from s group by path) select s.path, s.id from s join n using (path) where n between 1 and 2 union all select path, 'FILE:' || path from files where path not in (select path from n where n between 1 and 2)")
def change_seeds(spark, sf_dir):
    files = src.files(spark, sf_dir)
    s = src.symbols(files).where("exported and seq % 4 > 0")
    name = F.when(F.col("kind") == "METHOD", F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))
    return impact.change_seeds(files.select("path"), s.select("path", F.concat_ws(":", "kind", "path", name).alias("id")), 2)


@_query(f"with {HISTORY}, old as (select repository_id, nullif(status, 'P') as sha from h where run_id % 3 > 0), new as (select repository_id, run_id, nullif(status, 'P') as sha from h where run_id % 3 = 0) select n.repository_id, n.run_id, n.sha from new n where not exists (select 1 from old o where o.repository_id = n.repository_id and o.sha = n.sha)")
def history_append(spark, sf_dir):
    h = src.history(spark, sf_dir).select("repository_id", "run_id", F.nullif("status", F.lit("P")).alias("sha"))
    return tables.new_runs(h.where("run_id % 3 > 0"), h.where("run_id % 3 = 0"), ("repository_id", "sha"))


@_query(f"with {HISTORY} select run_id, created_at from h where repository_id % 3 = 0 order by created_at desc, run_id desc limit 20")
def history_list(spark, sf_dir):
    h = src.history(spark, sf_dir).where("repository_id % 3 = 0")
    return h.select("run_id", "created_at").orderBy(F.desc("created_at"), F.desc("run_id")).limit(20)


@_query(f"with {JOBS} select job, status, attempts from jobs where status in ('FAILED', 'DEAD_LETTER') order by updated_at desc, job limit 50")
def failed_jobs(spark, sf_dir):
    return tables.failed_jobs(_jobs(spark, sf_dir)).select("job", "status", "attempts")


@_query("with o as (select o_orderkey as id, case when o_orderkey % 6 > 0 then o_orderdate::timestamp + to_hours((o_orderkey % 3 + 1) * 24) end as expires_at from orders) select id, expires_at, coalesce(expires_at <= timestamp '1996-06-01', false) as expired from o")
def expiries(spark, sf_dir):
    k = F.col("o_orderkey")
    hours = F.make_dt_interval(hours=((k % 3 + 1) * 24).cast("int"))
    at = F.when(k % 6 > 0, F.col("o_orderdate").cast("timestamp") + hours)
    rows = src.table(spark, sf_dir, "orders").select(k.alias("id"), at.alias("expires_at"))
    return rows.withColumn("expired", F.coalesce(F.col("expires_at") <= F.lit("1996-06-01").cast("timestamp"), F.lit(False)))


#: Kinds of infrastructure in the order in which one deploys to the next, and the rules by path that show them.
INFRA = (("docker", "docker_present"), ("kubernetes", "kubernetes_present"), ("terraform", "terraform_present"), ("helm", "helm_changed"))


@_query(
    f"""with {FILES}, h as ({PRESENT}), r as (select distinct case rule when 'docker_present' then 0 when 'kubernetes_present' then 1 when 'terraform_present' then 2 when 'helm_changed' then 3 end as rank from h),
 k as (select rank, ['docker', 'kubernetes', 'terraform', 'helm'][rank + 1] as kind from r where rank is not null), n as (select kind as src, lead(kind) over (order by rank) as dst from k)
 select src, dst, 'DEPLOYS:' || src || ':' || dst as id, 'LOW' as confidence from n where dst is not null"""
)
def infra_chain(spark, sf_dir):
    found = paths.first_paths(src.files(spark, sf_dir), checks.PATH_RULES)
    of = lambda values: F.coalesce(*[F.when(F.col("rule") == rule, F.lit(v)) for (_, rule), v in zip(INFRA, values, strict=True)])
    kinds = found.select(of([k for k, _ in INFRA]).alias("kind"), of(range(len(INFRA))).alias("rank")).where("kind is not null")
    return graph.infra_chain(kinds)


@_query(f"with {FINDINGS} select id, severity, seq from findings order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end, seq limit 200")
def sorted_findings(spark, sf_dir):
    found = _findings(spark, sf_dir)
    return found.orderBy(tables.severity_rank(F.col("severity")), "seq").limit(200).select("id", "severity", "seq")


@_query(f"with {FINDINGS} select severity, count(*) as n from findings group by severity")
def check_summary(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@_query(
    GRAPH
    + f""", {FILES}, {SYMBOLS} select (select count(*) from files) as files, (select count(*) from files where {TEST_SQL}) as tests,
 (select count(*) from symbols where kind = 'FUNCTION') as functions, (select count(*) from symbols where kind = 'CLASS') as classes,
 (select count(*) from edges where type = 'IMPORTS') as dependencies, greatest((select count(*) from nodes where type = 'API_ROUTE'), (select count(*) from orders where o_orderstatus = 'F')) as api_routes"""
)
def repo_summary(spark, sf_dir):
    files = src.files(spark, sf_dir)
    marked = files.select("path", paths.is_test_file(F.col("path")).alias("is_test"))
    found = src.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")  # stand for routes of a detector
    return tables.summary(marked, src.symbols(files), src.nodes(spark, sf_dir), _edges(spark, sf_dir), found)


@_query(f"with {FILES}, {SYMBOLS} select path, {SYMBOL_ID} as id from symbols where (kind <> 'METHOD' and name = 'save') or (kind = 'METHOD' and (name = 'save' or owner || '.' || name = 'save' or ends_with(owner || '.' || name, '.save')))")
def symbol_lookup(spark, sf_dir):
    s = src.symbols(src.files(spark, sf_dir))
    full = F.when(F.col("kind") == "METHOD", F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))
    found = (F.col("name") == "save") | F.endswith(full, F.lit(".save"))
    return s.where(found).select("path", F.concat_ws(":", "kind", "path", full).alias("id"))


@_query("with c as (select event_type, event_id % 4 > 0 as resolved, event_id % 9 = 0 as noise from events) select event_type, count(*) filter (where resolved) as resolved, count(*) filter (where resolved or not noise) as total, round(100.0 * count(*) filter (where resolved) / nullif(count(*) filter (where resolved or not noise), 0), 6) as percent from c group by event_type")
def call_coverage(spark, sf_dir):
    n = F.col("event_id")
    c = src.table(spark, sf_dir, "events").select("event_type", (n % 4 > 0).alias("resolved"), (n % 9 == 0).alias("noise"))
    total = F.count_if(F.col("resolved") | ~F.col("noise"))
    counts = c.groupBy("event_type").agg(F.count_if("resolved").alias("resolved"), total.alias("total"))
    return counts.withColumn("percent", F.round(F.try_divide(100.0 * F.col("resolved"), F.col("total")), 6))


@_query("with r as (select event_type, ['TRUE', 'TRUE', 'FALSE', 'AMBIGUOUS'][event_id % 4 + 1] as verdict from events), c as (select event_type, count(*) filter (where verdict = 'TRUE') as t, count(*) filter (where verdict = 'FALSE') as f, count(*) filter (where verdict = 'AMBIGUOUS') as ambiguous from r group by 1) select event_type, t, f, ambiguous, printf('%.1f%%', 100.0 * t / (t + f)) as precision from c where t + f > 0")
def review_precision(spark, sf_dir):
    verdict = F.element_at(F.array(*map(F.lit, ("TRUE", "TRUE", "FALSE", "AMBIGUOUS"))), (F.col("event_id") % 4 + 1).cast("int"))
    r = src.table(spark, sf_dir, "events").select("event_type", verdict.alias("verdict"))
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    c = r.groupBy("event_type").agg(is_("TRUE").alias("t"), is_("FALSE").alias("f"), is_("AMBIGUOUS").alias("ambiguous")).where("t + f > 0")
    return c.withColumn("precision", F.format_string("%.1f%%", 100.0 * F.col("t") / (F.col("t") + F.col("f"))))


@_query(
    f"""with x as (select {KIND_SQL} as type, (event_id // 3) % 8 as c from events where event_id % 5 <> 0), b as (select * from x union all select 'overall', c from x),
 n as (select type, count(*) filter (where c in (0, 6, 7)) as tp, count(*) filter (where c = 1) as fp, count(*) filter (where c in (2, 3, 4)) as fn, count(*) filter (where c = 5) as low from b group by 1),
 s as (select type, floor(tp / (tp + fp) * 1000 + 0.5) / 1000 as precision, floor((tp + low) / (tp + low + fn) * 1000 + 0.5) / 1000 as recall from n),
 g as (select * from (values ('CALLS', 0.9::double, 0.8::double), ('IMPORTS', 0.95, 0.9), ('USES', 0.9, 0.75), ('HANDLED_BY', 0.9, 0.85), ('QUERIES', 0.85, 0.8), ('FETCHES', 0.85, 0.7), ('overall', 0.9, 0.8)) t(type, least_precision, least_recall))
 select type, precision, recall, least_precision, least_recall, coalesce(precision >= least_precision, true) and coalesce(recall >= least_recall, true) as attained from g join s using (type)"""
)
def target_attainment(spark, sf_dir):
    return coverage.attained(relationship_scores(spark, sf_dir).select("type", "precision", "recall"))


@_query(
    rf"""with {FILES}, l as (select path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from files),
 m as (select *, regexp_extract(text, '^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(', 1) as name, regexp_matches(text, '^\s*@') as at, regexp_matches(text, '^\s*(?:class|def|async\s+def)\b') as other from l),
 d as (select *, regexp_extract(text, '(?i)^\s*@[A-Za-z_]\w*\s*\.\s*(get|post|put|patch|delete|options|head|route|api_route)\s*\((.*)\)\s*$', 1) as verb, regexp_extract(text, '\((.*)\)\s*$', 1) as said from m),
 n as (select d.path, d.line, d.verb, d.said, arg_min(m.name, m.line) as name from d left join m on m.path = d.path and m.line between d.line + 1 and d.line + 11 and not m.at and (m.name <> '' or m.other) where d.verb <> '' group by all),
 r as (select *, regexp_extract(said, '[''"]([^''"]+)[''"]', 1) as route, list_transform(regexp_extract_all(regexp_extract(said, '(?i)methods\s*=\s*\[([^\]]*)\]', 1), '(?i)[''"](GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)[''"]', 1), lambda x: upper(x)) as listed from n)
 select path, line::int as line, unnest(case when lower(verb) not in ('route', 'api_route') then [upper(verb)] when len(listed) > 0 then listed else ['ALL'] end) as method,
  case when route like '/%' then route else '/' || route end as route, nullif(name, '') as handler, case when coalesce(name, '') <> '' then 'HIGH' else 'MEDIUM' end as confidence from r where route <> ''"""
)
def decorator_routes(spark, sf_dir):
    return lookahead.decorator_routes(src.files(spark, sf_dir))


MAPPED = r"""@(Get|Post|Put|Patch|Delete|Request)Mapping\s*(?:\(\s*(?:value\s*=\s*)?["'']([^"'']+)["''][^)]*\))?"""


@_query(
    rf"""with {FILES}, a as (select path, content, string_split_regex(content, '{MAPPED}') as parts, regexp_extract_all(content, '{MAPPED}') as m, regexp_extract_all(content, '{MAPPED}', 1) as v, regexp_extract_all(content, '{MAPPED}', 2) as p from files),
 k as (select *, unnest(range(1, len(m) + 1)) as k from a where len(m) > 0),
 t as (select *, array_to_string(list_transform(range(1, k + 1), lambda i: parts[i] || case when i < k then m[i] else '' end), '') as before, array_to_string(list_transform(range(k + 1, len(parts) + 1), lambda i: parts[i] || coalesce(m[i], '')), '')[1:400] as after from k)
 select path, len(string_split(before, chr(10)))::int as line, case v[k] when 'Request' then 'ALL' else upper(v[k]) end as method, case when coalesce(p[k], '') like '/%' then p[k] else '/' || coalesce(p[k], '') end as route,
  nullif(regexp_extract(after, '\b(?:public|protected|private)\s+(?:static\s+)?(?:[\w.<>\[\]]+)\s+(\w+)\s*\(', 1), '') as handler, nullif(regexp_extract(before, '\bclass\s+(\w+)', 1), '') as class from t"""
)
def mapping_routes(spark, sf_dir):
    return lookahead.mapping_routes(src.files(spark, sf_dir))
