"""The registered queries over the driver's tables, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.functions import text as fn
from ripplet.operators import checks, graph, impact, paths, tables
from ripplet.sources import driver_tables as src
from ripplet.sources.scratch import written
from ripplet.streaming import state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NODES = """nodes as (
 select 'PACKAGE:' || r_regionkey as id, 'PACKAGE' as type, r_name as name, 'packages/' || r_regionkey || '/index.ts' as file, r_regionkey::bigint as seq from region
 union all select 'MODULE:' || n_nationkey, 'MODULE', n_name, 'src/lib/' || n_nationkey || '.ts', 1000000000000 + n_nationkey from nation
 union all select 'SERVICE:' || s_suppkey, 'SERVICE', s_name, 'src/services/' || s_suppkey || '.service.ts', 2000000000000 + s_suppkey from supplier
 union all select 'CONTROLLER:' || c_custkey, 'CONTROLLER', c_name, 'src/controllers/' || c_custkey || '.controller.ts', 3000000000000 + c_custkey from customer
 union all select 'COMPONENT:' || p_partkey, 'COMPONENT', p_name, 'src/components/' || p_partkey || '.tsx', 4000000000000 + p_partkey from part
 union all select 'API_ROUTE:' || o_orderkey, 'API_ROUTE', 'POST /orders/' || o_orderkey, 'src/routes/' || o_orderkey || '.test.ts', 5000000000000 + o_orderkey from orders)"""
EDGES = """raw as (
 select 'MODULE:' || n_nationkey as src, 'PACKAGE:' || n_regionkey as dst, 'IMPORTS' as type, 'HIGH' as confidence, n_nationkey::bigint as seq, null::varchar as evidence from nation
 union all select 'SERVICE:' || s_suppkey, 'MODULE:' || s_nationkey, 'USES', 'HIGH', 1000000000000000 + s_suppkey, null from supplier
 union all select 'CONTROLLER:' || c_custkey, 'MODULE:' || c_nationkey, 'USES', 'MEDIUM', 2000000000000000 + c_custkey, null from customer
 union all select 'API_ROUTE:' || o_orderkey, 'CONTROLLER:' || o_custkey, 'CALLS', 'HIGH', 3000000000000000 + o_orderkey, null from orders
 union all select 'API_ROUTE:' || l_orderkey, 'COMPONENT:' || l_partkey, 'CALLS', case l_returnflag when 'N' then 'HIGH' when 'A' then 'MEDIUM' else 'LOW' end, 4000000000000000 + l_orderkey * 10 + l_linenumber, case when l_linestatus = 'O' then 'API_ROUTE:' || l_orderkey || ':COMPONENT:' || l_partkey || ':' || l_linenumber end from lineitem
 union all select 'API_ROUTE:' || l_orderkey, 'SERVICE:' || l_suppkey, 'IMPORTS', 'HIGH', 5000000000000000 + l_orderkey * 10 + l_linenumber, null from lineitem
 union all select 'COMPONENT:' || l_partkey, 'SERVICE:' || l_suppkey, 'DEPENDS_ON', 'MEDIUM', 6000000000000000 + l_orderkey * 10 + l_linenumber, null from lineitem
 union all select 'PACKAGE:' || n_regionkey, 'MODULE:' || n_nationkey, 'CONTAINS', 'HIGH', 7000000000000000 + n_nationkey, null from nation
 union all select 'API_ROUTE:' || n_nationkey, 'FILE:packages/' || n_regionkey || '/index.ts', 'TESTS', 'HIGH', 8000000000000000 + n_nationkey, null from nation
 union all select 'API_ROUTE:' || n_nationkey, 'FILE:src/lib/' || n_nationkey || '.ts', 'IMPORTS', 'MEDIUM', 9000000000000000 + n_nationkey, null from nation),
edges as (select src || '->' || dst || ':' || type as id, src, dst, type,
   case max(case confidence when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end) when 3 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as confidence,
   arg_min(evidence, seq) filter (where evidence is not null) as evidence, min(seq) as seq from raw group by src, dst, type)"""
#: Breadth-first levels as SQL: the least list of places wins a node.
BLAST = """pairs as (select src, dst, min(seq) as pair_seq, arg_min(confidence, seq) as confidence from edges group by src, dst having bool_or(type not in ('CONTAINS', 'EXPORTS'))),
l0 as (select id, 0 as depth, [id] as path, 'HIGH' as confidence, [seq] as ord from nodes where id = 'PACKAGE:1')""" + "".join(
    f""",
s{d} as (select p.src as id, list_append(f.path, p.src) as path, p.confidence, list_append(f.ord, p.pair_seq) as ord from l{d - 1} f join pairs p on f.id = p.dst),
l{d} as (select id, {d} as depth, arg_min(path, ord) as path, arg_min(confidence, ord) as confidence, min(ord) as ord from s{d} where id not in (select id from f{d - 1}) group by id),
f{d} as (select * from f{d - 1} union all select * from l{d})"""
    for d in (1, 2, 3)
).replace("s1 as", "f0 as (select * from l0),\ns1 as", 1) + ",\nfound as (select id, depth, path, confidence from f3)"
SENSITIVE = "regexp_matches(lower(name || ' ' || file), 'auth|payment|billing|security|migration|deploy|session|password|token|permission|rbac')"
HIT = f"hit as (select n.*, f.depth, f.path, f.confidence, case when f.depth = 0 or (f.depth <= 2 and {SENSITIVE}) then 'CRITICAL' when f.depth = 1 then 'HIGH' when f.depth = 2 then 'MEDIUM' else 'NEUTRAL' end as severity from found f join nodes n using (id))"
GRAPH = f"with {NODES}, {EDGES} "
REACH = f"with {NODES}, {EDGES}, {BLAST}, {HIT} "


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dedupe_edges(src.raw_edges(spark, sf_dir))


def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.nodes(spark, sf_dir).where("id = 'PACKAGE:1'").select("id", F.col("seq").alias("rank"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.blast_radius(_seed(spark, sf_dir), _edges(spark, sf_dir), 3)


def _hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.impacted(_found(spark, sf_dir).drop("order"), src.nodes(spark, sf_dir))


@_query(GRAPH + "select id, src, dst, type, confidence, evidence, seq from edges")
def edge_dedupe(spark, sf_dir):
    return _edges(spark, sf_dir)


@_query(f"with {NODES} select id, type, name, file, seq from nodes")
def node_dedupe(spark, sf_dir):
    n = src.nodes(spark, sf_dir)
    return graph.dedupe_nodes(n.unionByName(n.withColumn("seq", F.col("seq") + 10**15).withColumn("name", F.lit("later"))))


@_query(GRAPH + "select id, type from edges where src <> dst and src in (select id from nodes where type <> 'SERVICE') and dst in (select id from nodes where type <> 'SERVICE')")
def edge_admission(spark, sf_dir):
    edges = _edges(spark, sf_dir).select("src", "dst", "type")
    return graph.admit_edges(edges, src.nodes(spark, sf_dir).where("type <> 'SERVICE'")).select(graph.edge_id().alias("id"), "type")


@_query(REACH + "select id, depth, array_to_string(path, ' > ') as path, confidence from found")
def blast_radius_d3(spark, sf_dir):
    return _found(spark, sf_dir).select("id", "depth", F.array_join("path", " > ").alias("path"), "confidence")


@_query(REACH + "select severity, depth, type, count(*) as n from hit group by all")
def impact_severity(spark, sf_dir):
    return _hit(spark, sf_dir).groupBy("severity", "depth", "type").agg(F.count("*").alias("n"))


TESTED = """tested as (select id from hit where type = 'TEST' or file like '%.test.%' or file like '%.spec.%'
 union select e.src from edges e where e.type = 'TESTS' and e.src in (select id from nodes) and e.dst in (select id from hit where depth = 0 union all select 'FILE:' || file from hit where depth = 0)),
covered as (select distinct e.dst from edges e where e.src in (select id from tested)),
missing as (select id, name, file from hit where depth = 1 and not (type = 'TEST' or file like '%.test.%' or file like '%.spec.%')
 and id not in (select dst from covered) and 'FILE:' || file not in (select dst from covered))"""


def _tests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The impacted nodes, the related tests, and the direct impacts without one."""
    pairs = written(graph.pairs(_edges(spark, sf_dir), ("TESTS",)), "pairs")
    nodes = src.nodes(spark, sf_dir)
    found = graph.reached(_seed(spark, sf_dir), pairs.where("live"), 3)
    hit = written(impact.impacted(found.select("id", "depth"), nodes), "hit")
    tests = impact.related_tests(hit, pairs.where("TESTS").withColumn("type", F.lit("TESTS")), nodes)
    return hit, tests, impact.missing_tests(hit, pairs, tests)


@_query(REACH.rstrip() + f", {TESTED} select id, name, file from missing")
def missing_tests(spark, sf_dir):
    return _tests(spark, sf_dir)[2]


@_query(REACH.rstrip() + f", {TESTED} select id from tested")
def related_tests(spark, sf_dir):
    return _tests(spark, sf_dir)[1]


@_query(
    REACH.rstrip()
    + f""", {TESTED}, r as (select count(*) filter (where depth = 0) as changed, count(*) filter (where depth = 1) as direct, count(*) filter (where depth > 1) as indirect,
 count(*) filter (where type = 'API_ROUTE' or regexp_matches(file, 'route|controller|api/', 'i') or regexp_matches(name, 'route|controller', 'i')) as apis,
 count(distinct file) as files, coalesce(bool_or(depth <= 1 and {SENSITIVE}), false) as is_sensitive, (select count(*) from missing) as gaps, (select count(*) from tested) as tests from hit),
 s as (select *, least(100, 4 * changed + 3 * direct + indirect + 5 * apis + 6 * gaps + case when is_sensitive then 15 else 0 end)::bigint as score from r)
 select *, case when score >= 70 then 'Critical' when score >= 45 then 'Elevated' when score >= 20 then 'Moderate' else 'Low' end as level from s"""
)
def impact_report_row(spark, sf_dir):
    hit, tests, missing = _tests(spark, sf_dir)
    return impact.report(hit, missing, tests)


@_query(REACH + "select distinct file from hit")
def affected_files(spark, sf_dir):
    return _hit(spark, sf_dir).select("file").distinct()


@_query(GRAPH + "select type, count(*) as n from edges group by type")
def edge_type_histogram(spark, sf_dir):
    return graph.type_histogram(_edges(spark, sf_dir))


@_query(GRAPH + ", c as (select count(*) as n, count(*) filter (where confidence = 'HIGH') as high, count(*) filter (where confidence = 'MEDIUM') as medium, count(*) filter (where confidence = 'LOW') as low from edges) select *, floor(100.0 * high / n + 0.5)::bigint as high_pct, floor(100.0 * medium / n + 0.5)::bigint as medium_pct, floor(100.0 * low / n + 0.5)::bigint as low_pct from c")
def edge_confidence_mix(spark, sf_dir):
    return graph.confidence_mix(_edges(spark, sf_dir))


@_query(GRAPH + ", ids as (select id from nodes where type = 'SERVICE'), r as (select i.id, 'in' as direction, e.src as other, e.type, e.confidence from edges e join ids i on e.dst = i.id union all select i.id, 'out', e.dst, e.type, e.confidence from edges e join ids i on e.src = i.id) select r.*, n.type as other_type, n.name as other_name from r join nodes n on r.other = n.id")
def inspector(spark, sf_dir):
    n = src.nodes(spark, sf_dir)
    return graph.related(n.where("type = 'SERVICE'").select("id"), _edges(spark, sf_dir), n)


@_query(f"with {NODES} select id, type, name, file, seq from nodes where contains(lower(name), '12') or contains(lower(file), '12') or contains(lower(id), '12') order by seq limit 25")
def node_search(spark, sf_dir):
    return graph.search(src.nodes(spark, sf_dir), "12")


@_query(f"with {NODES} select name, min(id) as id from nodes where type in ('MODULE', 'SERVICE', 'COMPONENT') group by name having count(*) = 1")
def unique_name_resolution(spark, sf_dir):
    return graph.unique_names(src.nodes(spark, sf_dir), ("MODULE", "SERVICE", "COMPONENT"))


@_query(GRAPH + ", shown as (select id from nodes where type in ('SERVICE', 'COMPONENT', 'MODULE') order by seq limit 400), held as (select * from edges where type in ('CALLS', 'IMPORTS', 'DEPENDS_ON') and src in (select id from shown) and dst in (select id from shown) order by seq limit 800) select id, src, dst, type, seq from held")
def overview_projection(spark, sf_dir):
    return graph.overview(src.nodes(spark, sf_dir), _edges(spark, sf_dir), ("SERVICE", "COMPONENT", "MODULE"), ("CALLS", "IMPORTS", "DEPENDS_ON")).select("id", "src", "dst", "type", "seq")


@_query(
    GRAPH
    + """, nxt as (select src, arg_min(dst, seq) as dst from edges where type in ('CALLS', 'DEPENDS_ON', 'USES') group by src),
 w0 as (select id as start, [id] as way from nodes where type = 'API_ROUTE')"""
    + "".join(f", w{i} as (select start, case when n.dst is not null and not list_contains(way, n.dst) then list_append(way, n.dst) else way end as way from w{i - 1} w left join nxt n on w.way[-1] = n.src)" for i in (1, 2, 3, 4))
    + " select start, (unnest(range(len(way))))::int as hop, unnest(way) as node from w4"
)
def chain_4hop(spark, sf_dir):
    return graph.chain(src.nodes(spark, sf_dir).where("type = 'API_ROUTE'"), _edges(spark, sf_dir))


def _list(values) -> str:
    """Strings as a list of SQL."""
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _cases(value: str, rules) -> str:
    return "case " + " ".join(f"when regexp_matches({value}, {_text(p)}) then {_text(label)}" for p, label in rules) + " end"


FILES = f"""files as (select replace({_list(src.PATHS)}[doc_id % {len(src.PATHS)} + 1], '{{n}}', doc_id::varchar) as path, doc_id as seq,
 concat_ws(chr(10), array_to_string(list_transform(range(6), lambda k: {_list(src.CODE)}[(doc_id * 7 + k * 5) % {len(src.CODE)} + 1]), chr(10)), text,
 array_to_string(list_transform(range(6, 12), lambda k: {_list(src.CODE)}[(doc_id * 7 + k * 5) % {len(src.CODE)} + 1]), chr(10))) as content from documents)"""
SLASHED = "replace(path, '\\', '/')"


@_query(f"with {FILES}, c as (select {_cases(SLASHED, fn.INVENTORY)} as language, count(*) as n from files group by 1) select language, n, floor(100.0 * n / sum(n) over () + 0.5)::bigint as pct from (select * from c where language is not null)")
def language_mix(spark, sf_dir):
    return tables.language_mix(src.files(spark, sf_dir))


BASE = f"string_split({SLASHED}, '/')[-1]"


@_query(
    rf"""with {FILES}, k as (select {SLASHED} as path, seq, coalesce({_cases(BASE, tables.KINDS)}, case when regexp_extract({BASE}, '\.([^.]*)$', 1) = '' then 'other' else lower(regexp_extract({BASE}, '\.([^.]*)$', 1)) end) as kind
 from files where not regexp_matches({SLASHED}, {_text(paths.CODE_FILE)}) and not regexp_matches({SLASHED}, '(^|/)\.git/')),
 r as (select *, row_number() over (partition by kind order by seq) as r from k where not regexp_matches(kind, {_text(tables.NOISE)})),
 g as (select kind, count(*) as n, min(seq) as first, string_agg(path, ',' order by seq) filter (where r <= 3) as examples from r group by kind order by n desc, first limit 8) select kind, n, examples from g"""
)
def unsupported_groups(spark, sf_dir):
    files = src.files(spark, sf_dir)
    parsed = files.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).where(paths.is_code(F.col("path")))
    return tables.kind_groups(files, parsed)


def _findings(spark, sf_dir):
    return checks.line_findings(src.files(spark, sf_dir)).select("rule", "category", "severity", "file", "title", "seq", "id", "line", "evidence")


def _line_rule(i: int) -> str:
    rule, severity, title, most, held, never = checks.LINE_RULES[i]
    when = " and ".join(f"regexp_matches(text, {_text(p)})" for p in held) + (f" and not regexp_matches(text, {_text(never)})" if never else "")
    return f"select '{rule}' as rule, 'security' as category, '{severity}' as severity, path as file, '{title}' as title, seq * 1000000000 + no * 10 + {i} as seq, '{rule}:' || path || ':' || (no + 1) || ':{title}' as id, no + 1 as line, trim(text)[1:{most}] as evidence from lines where {when}"


FINDINGS = f"{FILES}, lines as (select path, seq, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) - 1 as no from files), findings as (" + " union all ".join(_line_rule(i) for i in range(len(checks.LINE_RULES))) + ")"


@_query(f"with {FINDINGS} select rule, category, severity, file, title, seq, id, line::int as line, evidence from findings")
def line_findings(spark, sf_dir):
    return _findings(spark, sf_dir)


@_query(f"with {FINDINGS}, g as (select unnest(['security', 'quality', 'cicd']) as category) select g.category, " + ", ".join(f"count(*) filter (where severity = '{s}') as {s}" for s in tables.SEVERITIES) + " from g left join findings f using (category) group by g.category")
def findings_pivot(spark, sf_dir):
    return tables.pivot_findings(_findings(spark, sf_dir), ("security", "quality", "cicd"))


@_query(f"with {FINDINGS}, r as (select *, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end as k from findings), a as (select rule, count(*) as n, min(k) as worst, arg_min(title, k * 10000000000000000 + seq) as title, min(seq) as first from r group by rule) select rule, n, worst, title from a order by worst, first limit 6")
def rule_rollup(spark, sf_dir):
    return tables.rule_rollup(_findings(spark, sf_dir))


@_query(f"with {FINDINGS} select rule, file, seq from findings where not (rule = 'secret_exposure' and regexp_matches(file, '^src/[^/]*/[^/]*$')) and not regexp_matches(file, '^packages/(.*/)?[^/]*\\.tsx$') and rule <> 'unsafe_env_handling'")
def suppress_rules(spark, sf_dir):
    rules = spark.createDataFrame([("secret_exposure", paths.glob_pattern("src/*/*")), ("*", paths.glob_pattern("packages/**/*.tsx")), ("unsafe_env_handling", None)], "rule string, pattern string")
    return tables.suppress(_findings(spark, sf_dir), rules).select("rule", "file", "seq")


@_query(f"with {FINDINGS}, r as (select *, row_number() over (partition by rule order by seq) as r from findings) select rule, file, seq from r where r <= 8 order by seq limit 40")
def cap_per_kind(spark, sf_dir):
    return tables.capped(_findings(spark, sf_dir), "rule", "seq", 8, 40).select("rule", "file", "seq")


RUN_MEASURES = (*tables.MEASURES, "direct", "indirect")
HISTORY = "h as (select o_custkey as repository_id, o_orderkey as run_id, o_orderdate as created_at, o_orderstatus as status, floor(o_totalprice)::bigint as impact, " + ", ".join(f"(floor(o_totalprice)::bigint + o_orderkey * {i + 3}) % {7 * i + 11} as {m}" for i, m in enumerate(RUN_MEASURES)) + " from orders)"


@_query(f"with {HISTORY} select repository_id, run_id, created_at, status, impact from h qualify row_number() over (partition by repository_id order by created_at desc, run_id desc) = 1")
def history_latest(spark, sf_dir):
    return tables.latest(src.history(spark, sf_dir)).select("repository_id", "run_id", "created_at", "status", "impact")


@_query(
    f"with {HISTORY}, d as (select repository_id, run_id, "
    + ", ".join(f"{m} - lag({m}) over w as d_{m}" for m in RUN_MEASURES)
    + " from h window w as (partition by repository_id order by created_at, run_id)) select *, case when 2 * d_direct + d_indirect > 0 then 'increased' when 2 * d_direct + d_indirect < 0 then 'decreased' when 2 * d_direct + d_indirect = 0 then 'unchanged' end as verdict from d"
)
def history_deltas(spark, sf_dir):
    return tables.deltas(src.history(spark, sf_dir))


@_query(f"with {HISTORY}, k as (select *, row_number() over (partition by repository_id order by created_at, run_id) as r, row_number() over (partition by repository_id order by created_at desc, run_id desc) as q from h), s as (select repository_id, max(impact) filter (where r = 1) as first, max(impact) filter (where q = 1) as last, greatest(max(impact), 1) as top from k group by 1) select *, last - first as delta from s")
def sparkline(spark, sf_dir):
    return tables.sparkline(src.history(spark, sf_dir))


@_query(
    """with u as (select page_id, url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) as scheme, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#@]+)', 1)) as found from pages)
 select page_id, case when found = '' then 'http' when ends_with(found, case scheme when 'http' then ':80' when 'https' then ':443' when 'ftp' then ':21' else ':none' end) then regexp_replace(found, ':\\d+$', '') else found end as host,
 case when regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1) end as path from u"""
)
def host_extract(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select("page_id", fn.host(F.col("url")).alias("host"), fn.route_path(F.col("url")).alias("path"))


@_query("select event_id, (event_id % 7)::bigint as attempt, least(60000, 2000 * pow(4, greatest(0, event_id % 7 - 1)))::bigint as wait_ms from events")
def backoff(spark, sf_dir):
    return src.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).alias("attempt"), fn.backoff_ms(F.col("event_id") % 7).alias("wait_ms"))


@_query("select delivery, event_id, event_type from (select event_id // 3 as delivery, * from events) qualify row_number() over (partition by delivery order by ts, event_id) = 1")
def delivery_dedupe(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("delivery"), "ts", "event_id", "event_type")
    return state.first_deliveries(e).select("delivery", "event_id", "event_type")


@_query("with a as (select user_id as job, ts, event_id, event_type = 'purchase' as ok, event_type <> 'click' as retryable from events), r as (select job, count(*) as attempts, last(ok order by ts, event_id) as ok, last(retryable order by ts, event_id) as retryable from a group by job) select job, attempts, case when ok then 'SUCCEEDED' when not retryable or attempts >= 3 then 'DEAD_LETTER' else 'RETRYING' end as status from r")
def job_fold(spark, sf_dir):
    a = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "ts", "event_id", (F.col("event_type") == "purchase").alias("ok"), (F.col("event_type") != "click").alias("retryable"))
    return state.retry_job(a)


@_query("with r as (select event_type as name, value, row_number() over (partition by event_type order by event_id desc) as r from events), l as (select name, count(*) as n, floor(avg(value) + 0.5)::bigint as avg, list(value order by value) as v from r where r <= 500 group by name) select name, n, avg, v[least(n, floor(0.95 * n)::bigint + 1)] as p95 from l")
def metrics_p95(spark, sf_dir):
    return tables.metric_summary(src.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", F.col("event_id").alias("seq")))


@_query("with s as (select quality = 0 as truth, regexp_matches(coalesce(text, ''), '[#*$%&]{3}| [|] ') as hit from labels join documents using (doc_id)), c as (select count(*) filter (where truth and hit) as tp, count(*) filter (where not truth and hit) as fp, count(*) filter (where truth and not hit) as fn from s), p as (select *, tp::double / nullif(tp + fp, 0) as p, tp::double / nullif(tp + fn, 0) as r from c) select tp, fp, fn, round(p, 3) as precision, round(r, 3) as recall, round(2 * p * r / nullif(p + r, 0), 3) as f1, round(tp::double / nullif(tp + fp + fn, 0), 3) as accuracy from p")
def precision_recall(spark, sf_dir):
    s = src.table(spark, sf_dir, "labels").join(src.table(spark, sf_dir, "documents"), "doc_id")
    return tables.precision_recall(s.select((F.col("quality") == 0).alias("truth"), F.coalesce(F.col("text"), F.lit("")).rlike(r"[#*$%&]{3}| [|] ").alias("hit")))


@_query(GRAPH + ", r as (select id, type, row_number() over (partition by type order by sha256('seed1' || id)) as r from edges) select id, type from r where r <= 10")
def stable_sample(spark, sf_dir):
    return tables.stable_sample(_edges(spark, sf_dir), "type", "id", 10, "seed1").select("id", "type")


@_query(f"with {FILES} select path, (1 + len(regexp_extract_all(array_to_string(string_split(content, chr(10))[2:9], chr(10)), {_text(fn.BRANCH)})))::int as complexity from files")
def cyclomatic(spark, sf_dir):
    return src.files(spark, sf_dir).select("path", fn.complexity(fn.span(F.col("content"), F.lit(2), F.lit(9))).alias("complexity"))
