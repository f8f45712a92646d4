"""Queries over the graph that wiring makes of parsed tables: its nodes, its edges, and what a change in it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.operators import graph, paths, wiring
from ripplet.plans.catalog import BLAST, FILES, _list, _query
from ripplet.plans.rules import ENV_SQL, SYMBOLS, TEST_SQL, TYPE_SQL
from ripplet.sources import driver_tables as src
from ripplet.sources import parsed_tables as parsed
from ripplet.sources.scratch import discard, written

NEXT = f"replace({_list(src.PATHS)}[(seq + 1) % {len(src.PATHS)} + 1], '{{n}}', (seq + 1)::varchar)"
CALLER = "case no % 2 when 0 then 'FUNCTION:' || path || ':run' || (seq % 5) else 'METHOD:' || path || ':Store.save' end"
#: The files' parsed tables again, typed from what they are said to hold.
TABLES = f"""{FILES}, {ENV_SQL}, {SYMBOLS}, wsym as (select path, seq, case when name = 'get' then 3 when kind = 'CLASS' then 1 when kind = 'METHOD' then 2 else 0 end as no, kind, owner, name, exported from symbols
  union all select path, seq, 4, 'FUNCTION', null, 'only' || seq, true from files union all select path, seq, 5, 'CLASS', null, 'Solo' || seq, false from files where seq % 2 = 0),
 sid as (select *, case kind when 'METHOD' then 'METHOD:' || path || ':' || owner || '.' || name else kind || ':' || path || ':' || name end as id from wsym),
 imports as (select path, seq, unnest(range(5)) as no, unnest(['../services/billing' || (seq - 5), '../../packages/core/src/auth/session' || (seq - 1) || '.ts', './path' || seq || '.x', 'react', './util' || (seq + seq % 2)]) as specifier,
  ['save', 'Store', 'run' || seq % 5, 'only' || (seq + 3), 'get'] as all_names from files),
 plain as (select *, regexp_replace(regexp_replace(regexp_replace(replace(coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') || '/' || specifier, '/./', '/'), '[^/]+/\\.\\./', ''), '[^/]+/\\.\\./', ''), '[^/]+/\\.\\./', '') as p from imports where specifier <> 'react'),
 tried as (select path, no, unnest(range(11)) as ord, unnest([p, p || '.ts', p || '.tsx', p || '.js', p || '.jsx', p || '.mjs', p || '.cjs', p || '/index.ts', p || '/index.tsx', p || '/index.js', p || '/index.jsx']) as c from plain),
 hit as (select path, no, arg_min(c, ord) as resolved from tried where c in (select path from files) group by all),
 imp as (select i.*, resolved, specifier || ' → ' || resolved as through from imports i join hit using (path, no)),
 words as (select path, seq, unnest(regexp_extract_all(content, '[A-Z][a-z]+')) as callee, generate_subscripts(regexp_extract_all(content, '[A-Z][a-z]+'), 1) - 1 as no from files),
 calls as (select *, {CALLER} as src, ['FUNCTION', 'METHOD', 'CLASS', 'EXTERNAL', 'MODULE', 'QUERY', 'UNRESOLVED'][(len(callee) + seq + no) % 7 + 1] as kind, case no % 3 when 0 then path when 1 then {NEXT} end as file,
  case len(callee) % 2 when 0 then 'Prisma.' || callee else 'Store' end as owner, case when no % 11 <> 0 then ['save', 'get', 'only' || (seq + no % 3), callee][len(callee) % 4 + 1] end as symbol,
  ['HIGH', 'LOW', 'MEDIUM', 'HIGH', 'LOW'][no % 5 + 1] as confidence from words),
 onef as (select name, min(id) as one from (select distinct id, name from sid where kind = 'FUNCTION') group by 1 having count(*) = 1),
 onec as (select name, min(id) as one from (select distinct id, name from sid where kind = 'CLASS') group by 1 having count(*) = 1),
 oneu as (select name, min(id) as one from (select distinct id, name from sid where kind in ('FUNCTION', 'CLASS')) group by 1 having count(*) = 1),
 aimed as (select c.*, case kind when 'EXTERNAL' then 'EXTERNAL_SERVICE:' || coalesce(symbol, file, 'http') when 'MODULE' then 'FILE:' || file when 'QUERY' then case when starts_with(owner, 'Prisma.') then 'DATABASE_MODEL:' || coalesce(file, 'prisma') || ':' || callee end
   when 'METHOD' then 'METHOD:' || file || ':' || owner || '.' || symbol when 'CLASS' then 'CLASS:' || file || ':' || symbol
   when 'FUNCTION' then coalesce(s.id, o.one) end as dst from calls c left join (select distinct id from sid where kind = 'FUNCTION') s on c.kind = 'FUNCTION' and s.id = 'FUNCTION:' || c.file || ':' || c.symbol left join onef o on c.symbol = o.name),
 longw as (select path, seq, unnest(regexp_extract_all(content, '[a-z]{{9,}}')) as model, generate_subscripts(regexp_extract_all(content, '[a-z]{{9,}}'), 1) - 1 + 2000000 as no from files),
 r as (select path, seq, no, 'API_ROUTE:' || path || ':' || no as id, ['GET', 'POST', 'ALL', 'PUT'][no + 1] as method, '/r' || seq || '/' || no as route, ['HIGH', 'MEDIUM', 'LOW', 'HIGH'][no + 1] as confidence from files, range(4) t(no))"""
#: Places: the part times 2^58, the file times 2^26, the phase times 2^23, twice the number.
AT = "{part} * 288230376151711744 + seq::bigint * 67108864 + {phase} * 8388608 + no * 2 + {second}"


def _at(part: int, phase: int, second: int = 0) -> str:
    return AT.format(part=part, phase=phase, second=second)


WIRED_NODES = f"""made as (select dst as id, 'EXTERNAL_SERVICE' as type, coalesce(symbol, file, 'http') as name, path as file, 'http,fetch' as about, {_at(1, 2)} as seq from aimed where kind = 'EXTERNAL'
  union all select dst, 'DATABASE_MODEL', callee, coalesce(file, path), 'prisma,' || callee, {_at(1, 2)} from aimed where kind = 'QUERY' and dst is not null
  union all select 'DATABASE_MODEL:' || path || ':' || model, 'DATABASE_MODEL', model, path, case when ends_with(path, '.go') then 'gorm' else 'prisma' end || ',findMany', {_at(1, 2)} from longw
  union all select id, 'API_ROUTE', method || ' ' || route, path, 'express,' || method || ',' || route || ',' || ['get', 'save,Store', 'default', 'gone'][no + 1] || ',' || confidence, {_at(2, 0)} from r),
 wnodes as (select 'FILE:' || path as id, {TYPE_SQL} as type, string_split(path, '/')[-1] as name, path as file, null as about from files
  union all select id, kind, case kind when 'METHOD' then owner || '.' || name else name end, path, null from sid union all select 'ENV_VARIABLE:' || path || ':' || name, 'ENV_VARIABLE', name, path, null from env
  union all select id, arg_min(type, seq), arg_min(name, seq), arg_min(file, seq), arg_min(about, seq) from made group by id)"""
NONE = "null as file, null as line, null as snippet, null as through, null as symbol"
WIRED_EDGES = f"""wraw as (select 'CLASS:' || path || ':' || owner as src, id as dst, 'CONTAINS' as type, 'HIGH' as confidence, {_at(0, 0)} as seq, {NONE} from sid where kind = 'METHOD'
  union all select 'FILE:' || path, id, 'CONTAINS', 'HIGH', {_at(0, 1)}, null, null, null, null, null from sid
  union all select 'FILE:' || path, id, 'EXPORTS', 'HIGH', {_at(0, 2)}, null, null, null, null, null from sid where kind <> 'METHOD' and exported
  union all select 'FILE:' || path, 'ENV_VARIABLE:' || path || ':' || name, 'READS', 'HIGH', {_at(0, 3).replace("no * 2", "0")}, null, null, null, null, null from env join files using (path)
  union all select 'FILE:' || path, 'FILE:' || resolved, 'IMPORTS', 'HIGH', {_at(1, 0)}, path, null, case no when 1 then 'import session from "' || specifier || '"' else 'import {{ save, Store, ' || all_names[3] || ', ' || all_names[4] || ', … }} from "' || specifier || '"' end, through, null from imp
  union all select 'FILE:' || path, 'FILE:' || resolved, 'TESTS', 'HIGH', {_at(1, 3)}, null, null, null, null, null from imp where {TEST_SQL}
  union all select 'FILE:' || n.path, coalesce(h.id, o.one), 'USES', case when h.id is null then 'MEDIUM' else 'HIGH' end, {_at(1, 0, 1).replace("seq::", "n.seq::").replace("no *", "n.no *")}, n.path, null, 'import {{ ' || n.name || ' }} from "' || specifier || '"', through, n.name
    from (select *, unnest(all_names) as name from imp where no <> 1) n left join (select path, name, max(kind) || ':' || path || ':' || name as id from sid where kind <> 'METHOD' group by path, name) h on h.path = n.resolved and h.name = n.name left join oneu o on o.name = n.name
  union all select case side when 0 then src else 'FILE:' || path end, dst, case kind when 'MODULE' then 'IMPORTS' when 'QUERY' then 'QUERIES' when 'EXTERNAL' then 'FETCHES' else 'CALLS' end, confidence, {_at(1, 2)} + side, path, no + 1, callee || '(…)',
    lower(kind) || ' ' || coalesce(symbol, callee) || coalesce(' in ' || file, ''), callee from aimed, range(2) t(side) where side = 0 or kind = 'MODULE'
  union all select {CALLER}, 'DATABASE_MODEL:' || path || ':' || model, 'QUERIES', 'MEDIUM', {_at(1, 2)}, null, null, null, null, null from longw
  union all select 'CLASS:' || path || ':Store', coalesce(o.one, 'CLASS:' || path || ':' || d.name), 'DEPENDS_ON', 'HIGH', {_at(1, 2)}, null, null, null, null, null
    from (select path, seq, unnest(['Store', 'Solo' || (seq + 1), 'Nowhere']) as name, unnest([3000000, 3000001, 3000002]) as no from files) d left join onec o using (name)
  union all select id, 'FILE:' || path, 'DEPENDS_ON', confidence, {_at(2, 0)}, null, null, null, null, null from r
  union all select 'FILE:' || path, id, 'CONFIGURES', confidence, {_at(2, 1)}, null, null, null, null, null from r
  union all select id, case no when 0 then 'FUNCTION:' || path || ':get' when 1 then 'METHOD:' || {NEXT} || ':Store.save' else 'FUNCTION:' || path || ':gone' end, 'HANDLED_BY', confidence, {_at(2, 2)}, null, null, null, null, null from r where no <> 2
  union all select id, 'FUNCTION:' || path || case no when 0 then ':get' else ':gone' end, 'USES', confidence, {_at(2, 3)}, null, null, null, null, null from r where no in (0, 3)),
 edges as (select src || '->' || dst || ':' || type as id, src, dst, type, case max(case confidence when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end) when 3 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as confidence, min(seq) as seq,
  arg_min([file, line::varchar, snippet, through, symbol], seq) filter (where snippet is not null) as proof from wraw where src <> dst and src in (select id from wnodes) and dst in (select id from wnodes) group by src, dst, type)"""


def _wired(spark: SparkSession, sf_dir: str, edges_too: bool = True) -> tuple[DataFrame, DataFrame]:
    files = written(src.files(spark, sf_dir), "files")  # all parsed tables read it
    imports = paths.resolve_imports(parsed.imports(files), files)
    imports = written(imports, "imports") if edges_too else imports  # no node is made of an import
    tests = files.where(paths.file_type(F.col("path")) == "TEST")
    symbols, calls = written(parsed.symbols(files), "symbols"), written(parsed.calls(files), "calls")
    rest = [of(files) for of in (parsed.queries, parsed.dependencies, parsed.routes)]
    nodes, edges = wiring.wired(files, symbols, parsed.env_variables(files), imports, calls, *rest, tests)
    discard(calls)  # those with targets are written
    return nodes, edges


@_query(f"with {TABLES}, {WIRED_NODES} select id, type, name, file, about from wnodes")
def wired_nodes(spark, sf_dir):
    """The graph's nodes, with what is told about those made on demand."""
    nodes, _ = _wired(spark, sf_dir, edges_too=False)
    return nodes.select("id", "type", "name", "file", F.array_join(F.map_values("metadata"), ",").alias("about"))


@_query(f"with {TABLES}, {WIRED_NODES}, {WIRED_EDGES} select id, src, dst, type, confidence, seq, proof[1] as file, proof[2]::int as line, proof[3] as snippet, proof[4] as through, proof[5] as symbol from edges")
def wired_edges(spark, sf_dir):
    """The graph's edges with their evidence."""
    _, edges = _wired(spark, sf_dir)
    proof = {"file": "file", "start_line": "line", "snippet": "snippet", "resolved_through": "through", "symbol": "symbol"}
    return edges.select("id", "src", "dst", "type", "confidence", "seq", *[F.col(f"evidence.{a}").alias(b) for a, b in proof.items()])


@_query(
    f"with {TABLES}, {WIRED_NODES}, {WIRED_EDGES}, "
    + BLAST.replace("[seq] as ord from nodes where id = 'PACKAGE:1'", "[0::bigint] as ord from (select 'FUNCTION:' || path || ':get' as id from files where seq = 3)")
    + " select id, depth, path, confidence from found"
)
def wired_blast_radius(spark, sf_dir):
    """What a change of one function reaches in the graph, by three hops."""
    _, edges = _wired(spark, sf_dir)
    seeds = src.files(spark, sf_dir).where("seq = 3").select(F.concat(F.lit("FUNCTION:"), "path", F.lit(":get")).alias("id"), F.lit(0).cast("long").alias("rank"))
    # Edges aren't written: only pairs are made of them, without ids and evidence.
    return graph.blast_radius(seeds, edges).select("id", "depth", "path", "confidence")
