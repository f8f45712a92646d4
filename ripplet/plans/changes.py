"""Queries over changes: the old side of patches, events between snapshots of symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplet.operators import semantic
from ripplet.plans.catalog import FILES, _query
from ripplet.plans.rules import PATCH
from ripplet.sources import driver_tables as src

OLD_SQL = r"""pl as (select path, unnest(string_split(patch, chr(10))) as text, generate_subscripts(string_split(patch, chr(10)), 1) as no from patches),
 hl as (select *, case when regexp_matches(text, '^@@\s+-\d+(,\d+)?\s+\+\d+(,\d+)?\s+@@') then regexp_extract(text, '\+(\d+)', 1)::int end as begins from pl),
 hn as (select *, count(begins) over w as hunk, last_value(begins ignore nulls) over w as new_start from hl window w as (partition by path order by no)),
 body as (select * from hn where hunk > 0 and begins is null and regexp_matches(text, '^([+ -]|$)') and not regexp_matches(text, '^(\+\+\+|---|diff |similarity |rename )')),
 span as (select path, hunk, any_value(new_start) as new_start, count(*) filter (where not starts_with(text, '-')) as size from body group by 1, 2),
 cl as (select path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) - 1 as pos from files),
 left_ as (select path, text, pos, 1 as kind, 0 as no from cl where not exists (select 1 from span s where s.path = cl.path and pos >= s.new_start - 1 and pos < s.new_start - 1 + s.size)),
 put as (select path, text[2:] as text, new_start - 1 as pos, 0 as kind, no from body where not starts_with(text, '+')),
 whole as (select path, string_agg(text, chr(10) order by pos, kind, no) as old_content from (select * from left_ union all select * from put) group by path)"""


@_query(f"with {FILES}, {PATCH}, {OLD_SQL} select path, old_content from whole")
def old_sides(spark, sf_dir):
    files = src.files(spark, sf_dir)
    changed = src.patches(files, "content").withColumn("change", F.lit(1))
    return semantic.old_sides(changed).select("path", "old_content")


SNAPS = r"""l as (select doc_id // 2 as change, doc_id % 2 as side, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as no from documents),
 w as (select *, regexp_extract_all(body, '[A-Za-z]+') as w from l), n as (select *, lower(w[1]) as name from w where len(w) > 0),
 k as (select change, side, name, case when len(name) % 7 = 0 then 'CLASS' when len(name) % 2 = 0 then 'METHOD' else 'FUNCTION' end as kind, arg_max(w, no) as w, arg_max(body, no) as body from n group by 1, 2, 3, 4),
 s as (select change, side, 'src/change' || change || '.ts' as path, kind, case when kind = 'METHOD' then 'C' || name[1] end as owner, name, list_transform(w[2:4], lambda x: x || ':' || len(x)) as parameters, w[-1] as return_type, list_distinct(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) as calls, body from k),
 i as (select *, case when kind = 'METHOD' then 'METHOD:' || path || ':' || owner || '.' || name else kind || ':' || path || ':' || name end as symbol_id from s),
 o as (select * from i where side = 0), nn as (select * from i where side = 1),
 b as (select o.*, n.parameters as p2, n.return_type as r2, n.calls as c2, n.body as b2 from o join nn n using (symbol_id) where o.kind <> 'CLASS'),
 c as (select *, list_filter(list_distinct(p2), lambda x: not list_contains(parameters, x)) as pa, list_filter(list_distinct(parameters), lambda x: not list_contains(p2, x)) as pr, array_to_string(parameters, '|') as j1, array_to_string(p2, '|') as j2 from b),
 events as (
  select symbol_id, kind || '_REMOVED' as kind, null::varchar as detail, null::varchar as "from", null::varchar as "to" from o where symbol_id not in (select symbol_id from nn)
  union all select symbol_id, kind || '_ADDED', null, null, null from nn where symbol_id not in (select symbol_id from o)
  union all select symbol_id, 'PARAMETER_ADDED', unnest(pa), null, null from c
  union all select symbol_id, 'PARAMETER_REMOVED', unnest(pr), null, null from c
  union all select symbol_id, 'RETURN_TYPE_CHANGED', null, return_type, r2 from c where return_type <> r2
  union all select symbol_id, 'SIGNATURE_CHANGED', null, j1, j2 from c where (len(pa) + len(pr) > 0 or return_type <> r2) and j1 <> j2
  union all select symbol_id, 'CALL_ADDED', unnest(list_filter(c2, lambda x: not list_contains(calls, x))), null, null from c
  union all select symbol_id, 'CALL_REMOVED', unnest(list_filter(calls, lambda x: not list_contains(c2, x))), null, null from c
  union all select symbol_id, 'BODY_CHANGED', null, null, null from c where body <> b2)"""


def _events(spark, sf_dir):
    s = src.snapshots(spark, sf_dir)
    return semantic.symbol_events(s.where("side = 'old'"), s.where("side = 'new'"))


@_query(f'with {SNAPS} select symbol_id, kind, detail, "from", "to" from events')
def symbol_events(spark, sf_dir):
    return _events(spark, sf_dir).select("symbol_id", "kind", "detail", "from", "to")


@_query(
    f"""with {SNAPS} select string_split(symbol_id, ':')[2] as path, case when bool_or(regexp_matches(kind, '^(METHOD|FUNCTION|CLASS)_(ADDED|REMOVED)$')) then 'STRUCTURAL'
 when bool_or(kind in ('SIGNATURE_CHANGED', 'PARAMETER_ADDED', 'PARAMETER_REMOVED', 'RETURN_TYPE_CHANGED')) then 'INTERFACE' else 'BEHAVIORAL' end as category from events group by 1"""
)
def change_categories(spark, sf_dir):
    return semantic.change_categories(_events(spark, sf_dir)).select("path", "category")
