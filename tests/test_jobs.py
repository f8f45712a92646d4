"""Streams of jobs and requests: across micro-batches and a restart, against the batch forms and plain versions."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from ripplet.streaming import jobs
from tests.test_streams import START

EVENT = "key string, ts timestamp, event_id long, enqueue boolean, job string, status string, part int"
REQUEST = "client long, ts timestamp, event_id long, part int"


@pytest.fixture(scope="module")
def store(spark):
    conf = {"spark.sql.streaming.stateStore.providerClass": jobs.STATE_STORE, "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, tmp_path, rows, schema, build, parts):
    """Adds the given parts' files to the source and runs the stream over what is new, from its checkpoint."""
    df = spark.createDataFrame(rows, schema)
    for k in parts:
        df.where(F.col("part") == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = build(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def folded(rows):
    """One event after the other."""
    active, out = {}, []
    for key, _, event, enqueue, job, status, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if enqueue:
            deduped = key is not None and key in active
            if key is not None and not deduped:
                active[key] = job
            out.append((key, event, active.get(key, job) if key is not None else job, deduped))
        elif key in active and job in (None, active[key]) and status not in jobs.ACTIVE:
            del active[key]
    return sorted(out, key=str)


def test_twenty_enqueues_of_one_sha_are_one_job_across_batches_and_a_restart(spark, tmp_path, store):
    rows = [("sha", at(i), i, True, f"job{i}", None, i // 5) for i in range(20)]
    rows += [("sha", at(20), 20, False, "job0", "RUNNING", 4), ("sha", at(21), 21, True, "job21", None, 4), ("sha", at(22), 22, False, None, "SUCCEEDED", 4), ("sha", at(23), 23, True, "job23", None, 4)]
    rows += [("other", at(3), 30, True, "job30", None, 0), ("other", at(24), 31, False, "job9", "DEAD_LETTER", 4), ("other", at(25), 32, True, "job32", None, 4), (None, at(4), 40, True, "job40", None, 0), (None, at(5), 41, True, "job41", None, 1)]
    first = run(spark, tmp_path, rows, EVENT, jobs.stream_enqueued, [0, 1])
    assert {r[2] for r in first if r[0] == "sha"} == {"job0"}
    got = run(spark, tmp_path, rows, EVENT, jobs.stream_enqueued, [2, 3, 4])
    assert sorted(got, key=str) == folded(rows)
    assert [r[2] for r in got if r[0] == "sha" and not r[3]] == ["job0", "job23"]


def test_the_batch_form_is_a_fold(spark):
    rng, rows = random.Random(4), []
    for i in range(400):
        enqueue = rng.random() < 0.7
        key = rng.choice(["a", "b", "c", None])
        rows.append((key, at(i // 2), i, enqueue, f"job{i}" if enqueue else None, None if enqueue else rng.choice(["RUNNING", "SUCCEEDED", "DEAD_LETTER", "FAILED", None]), 0))
    got = jobs.enqueued(spark.createDataFrame(rows, EVENT)).collect()
    assert sorted(map(tuple, got), key=str) == folded(rows)
    assert jobs.enqueued(spark.createDataFrame([], EVENT)).collect() == []


def windows(rows, limit, seconds):
    state, out = {}, []
    for client, ts, event, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        reset, used = state.get(client, (None, 0))
        if reset is None or reset <= ts:
            reset, used = ts + datetime.timedelta(seconds=seconds), 0
        allowed = used < limit
        state[client] = (reset, used + allowed)
        out.append((client, event, allowed, limit - used - 1 if allowed else 0, 0 if allowed else max(1, math.ceil((reset - ts).total_seconds()))))
    return sorted(out, key=str)


REQUESTS = [(c, at(s + c / 2), 100 * c + i, i // 3) for c in (1, 2) for i, s in enumerate([0, 1, 2, 59, 60, 61, 62, 63, 64, 125, 300, 301.5])]


def test_limits_of_a_stream_open_their_window_with_the_first_request_and_end(spark, tmp_path, store):
    got = run(spark, tmp_path, REQUESTS, REQUEST, lambda s: jobs.stream_limited(s, 3, 60), [0, 1])
    got = run(spark, tmp_path, REQUESTS, REQUEST, lambda s: jobs.stream_limited(s, 3, 60), [2, 3])
    assert got == windows(REQUESTS, 3, 60) and any(r[4] > 1 for r in got)


def test_limits_in_batch(spark):
    rng = random.Random(6)
    rows = REQUESTS + [(5, at(rng.randrange(4_000) / 4), 1_000 + i, 0) for i in range(500)]
    assert sorted(map(tuple, jobs.limited(spark.createDataFrame(rows, REQUEST), 3, 60).collect()), key=str) == windows(rows, 3, 60)
    assert jobs.limited(spark.createDataFrame([], REQUEST)).collect() == []


def test_updates_keep_set_and_clear_fields(spark):
    schema = "job string, ts timestamp, status string, attempts long, last_error string, phase string, commit_sha string"
    created = spark.createDataFrame([("a", at(0), "QUEUED", 0, None, None, "sha"), ("b", at(0), "QUEUED", 0, None, None, None)], schema)
    rows = [
        ("a", at(1), 1, None, "RUNNING", 1, "old error", "CLONING", None),
        ("a", at(2), 2, ["last_error", "status"], None, None, None, None, None),
        ("a", at(2), 3, ["phase"], "RETRYING", None, None, None, None),
        ("a", at(-1), 4, None, "FAILED", 9, "before it was", None, None),
        ("unknown", at(5), 5, None, "FAILED", 1, None, None, None),
        ("b", at(3), 6, ["commit_sha"], None, None, None, None, "not kept"),
        ("b", at(4), 7, None, None, None, None, "QUEUED", "late"),
    ]
    updates = spark.createDataFrame(rows, "job string, ts timestamp, event_id long, cleared array<string>, status string, attempts long, last_error string, phase string, commit_sha string")
    got = sorted(tuple(r) for r in jobs.job_records(created, updates).select("job", "created_at", "updated_at", "status", "attempts", "last_error", "phase", "commit_sha").collect())
    assert got == [("a", at(0), at(2), "RETRYING", 1, None, None, "sha"), ("b", at(0), at(4), "QUEUED", 0, None, "QUEUED", "late")]
