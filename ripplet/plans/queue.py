"""Queries over jobs and requests: the batch forms of the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ripplet.operators import webhooks
from ripplet.plans.catalog import _query
from ripplet.sources import driver_tables as src
from ripplet.sources.scratch import shared_dir
from ripplet.sources.store import Store
from ripplet.streaming import jobs, state


@_query(
    """with e as (select 'u' || user_id as key, ts, event_id, event_type <> 'purchase' as enqueue, 'job' || event_id as job from events),
 t as (select *, sum(case when enqueue then 0 else 1 end) over (partition by key order by ts, event_id) as turn from e)
 select key, event_id, first(job) over w as job, row_number() over w > 1 as deduped from t where enqueue window w as (partition by key, turn order by ts, event_id)"""
)
def enqueued_jobs(spark, sf_dir):
    text = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    enqueue = F.col("event_type") != "purchase"
    job, status = F.when(enqueue, text("job", "event_id")), F.when(~enqueue, "SUCCEEDED")
    e = src.table(spark, sf_dir, "events")
    return jobs.enqueued(e.select(text("u", "user_id").alias("key"), "ts", "event_id", enqueue.alias("enqueue"), job.alias("job"), status.alias("status")))


@_query(
    """with recursive r as (select user_id as client, event_id, epoch_us(ts) as t from events),
 w as (select client, min(t) as t from r group by 1 union all select w.client, n.t from w, lateral (select min(r.t) as t from r where r.client = w.client and r.t >= w.t + 3600000000) n where n.t is not null),
 o as (select r.*, w.t as opened from r asof join w on r.client = w.client and r.t >= w.t),
 k as (select *, row_number() over (partition by client, opened order by t, event_id) as nth from o)
 select client, event_id, nth <= 3 as allowed, greatest(0, 3 - nth) as remaining, case when nth <= 3 then 0 else greatest(1, ceil((opened + 3600000000 - t) / 1e6)) end::bigint as retry_after from k"""
)
def request_limits(spark, sf_dir):
    requests = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "ts", "event_id")
    return jobs.limited(requests, 3, 3_600)


@_query(
    """with u as (select user_id as job, ts, event_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as nth from events),
 c as (select job, ts as created_at from u where nth = 1),
 x as (select job, ts, event_id, case when event_type in ('click', 'view') then 'RUNNING' when event_type = 'purchase' then 'SUCCEEDED' end as status, floor(value)::bigint as attempts, case when event_id % 3 = 0 then 'error ' || event_id end as last_error, event_id % 4 = 1 as cleared from u where nth > 1)
 select c.job, created_at, greatest(created_at, max(ts)) as updated_at, coalesce(arg_max(status, (ts, event_id)) filter (where status is not null), 'QUEUED') as status, coalesce(arg_max(attempts, (ts, event_id)) filter (where attempts is not null), 0) as attempts,
  arg_max({'v': case when not cleared then last_error end}, (ts, event_id)) filter (where cleared or last_error is not null).v as last_error from c left join x using (job) group by 1, 2"""
)
def job_records(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").withColumn("job", F.col("user_id"))
    created = e.groupBy("job").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    n, kind = F.col("event_id"), F.col("event_type")
    updates = e.join(created, "job").where(F.struct("ts", "event_id") > F.col("f")).select(
        "job",
        "ts",
        "event_id",
        F.when(n % 4 == 1, F.array(F.lit("last_error"))).alias("cleared"),
        F.when(kind.isin("click", "view"), "RUNNING").when(kind == "purchase", "SUCCEEDED").alias("status"),
        F.floor("value").cast("long").alias("attempts"),
        F.when(n % 3 == 0, F.concat(F.lit("error "), n.cast("string"))).alias("last_error"),
    )
    first = created.select("job", "f.ts", F.lit("QUEUED").alias("status"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("last_error"))
    return jobs.job_records(first, updates)


@_query(
    """with a as (select o_custkey as repository_id, o_orderkey as analysis_id, o_orderdate::timestamp as analyzed_at, o_orderstatus as status from orders),
 r as (select repository_id, arg_max(a, (analyzed_at, analysis_id)) as l from a group by 1)
 select l.repository_id, l.analysis_id, l.analyzed_at, l.status, c_name as repository from r join customer on c_custkey = repository_id"""
)
def saved_analyses(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("analysis_id"), F.col("o_orderdate").cast("timestamp").alias("analyzed_at"), F.col("o_orderstatus").alias("status"))
    store = Store(spark, f"{shared_dir(spark)}/analyses-{uuid.uuid4().hex}", "repository_id", 16)
    order = ["analyzed_at", "analysis_id"]
    for batch, status in enumerate(("F", "O", "P")):  # each batch is upserted over those before it, if it is newer
        new = rows.where(F.col("status") == status)
        if batch:
            new = new.unionByName(store.read())
        store.upsert(new, order, "orders", batch)
    names = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repository_id"), F.col("c_name").alias("repository"))
    return store.read().join(names, "repository_id")


#: Deliveries made of the events table: of four signatures one is of another key.
HOOKS = """h as (select event_id, ts, 'd' || (event_id // 3) as delivery, case event_type when 'click' then 'push' when 'view' then 'ping' else 'pull_request' end as event, event_id % 4 = 3 as forged,
 ['opened', 'closed', 'synchronize'][event_id % 3 + 1] as action, event_id % 5 = 0 as draft, case when event_id % 7 > 0 then 'Org' || user_id % 9 end as owner, 'repo' || user_id as repo, floor(value)::bigint as number, 'sha' || event_id % 11 as sha from events)"""


def _deliveries(spark, sf_dir):
    n, user = F.col("event_id"), F.col("user_id")
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    kind = F.when(F.col("event_type") == "click", "push").when(F.col("event_type") == "view", "ping").otherwise("pull_request")
    owner = F.struct(F.when(n % 7 > 0, text("Org", user % 9)).alias("login"))
    head = F.struct(text("sha", n % 11).alias("sha"))
    pull = F.struct(F.floor("value").cast("long").alias("number"), (n % 5 == 0).alias("draft"), head.alias("head"))
    action = F.element_at(F.array(*map(F.lit, ("opened", "closed", "synchronize"))), (n % 3 + 1).cast("int"))
    body = F.to_json(F.struct(action.alias("action"), pull.alias("pull_request"), F.struct(text("repo", user).alias("name"), owner.alias("owner")).alias("repository")))
    rows = src.table(spark, sf_dir, "events").select(text("d", F.floor(n / 3)).alias("delivery"), kind.alias("event"), body.alias("body"), "ts", n)
    signed = F.when(n % 4 == 3, webhooks.hmac_sha256("other", F.col("body"))).otherwise(webhooks.hmac_sha256("secret", F.col("body")))
    return rows.withColumn("signature", F.concat(F.lit("sha256="), signed))


DECISION = """case when forged then 'unauthorized' when event = 'ping' then 'pong' when event <> 'pull_request' or action = 'closed' or draft then 'ignored' when owner is null or coalesce(number, 0) = 0 then 'incomplete' else 'accepted' end"""


@_query(f"with {HOOKS} select event_id, {DECISION} as decision from h")
def webhook_decisions(spark, sf_dir):
    return webhooks.decided(_deliveries(spark, sf_dir), "secret").select("event_id", "decision")


@_query(
    f"""with {HOOKS}, a as (select * from h where {DECISION} = 'accepted'), f as (select delivery, arg_min(a, (ts, event_id)) as e from a group by 1)
 select 'pr:' || lower(e.owner) || '/' || lower(e.repo) || '#' || e.number || '@' || e.sha as key, e.event_id as event_id, 'job:' || delivery as job from f"""
)
def webhook_enqueues(spark, sf_dir):
    accepted = webhooks.decided(_deliveries(spark, sf_dir), "secret").where("decision = 'accepted'")
    return webhooks.enqueues(state.first_deliveries(accepted)).select("key", "event_id", "job")
