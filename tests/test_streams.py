"""The stream forms against the batch forms and a plain version."""

import datetime

from pyspark.sql import functions as F

from ripplet.streaming import state

START = datetime.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema, by):
    """rows as a stream: one file for each value of the column `by`, in its order."""
    df = spark.createDataFrame(rows, schema)
    for k in sorted({r[by] for r in df.select(by).collect()}):
        df.where(F.col(by) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def collected(spark, tmp_path, df, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_first_deliveries_of_a_stream(spark, tmp_path):
    rows = [(i % 7, START + datetime.timedelta(seconds=i), i, i // 10) for i in range(40)]
    events = stream(spark, tmp_path, rows, "delivery long, ts timestamp, event_id long, part int", "part")
    got = collected(spark, tmp_path, state.stream_first_deliveries(events), "deliveries")
    assert sorted(r.delivery for r in got) == list(range(7)) and {r.part for r in got} == {0}
    batch = state.first_deliveries(spark.createDataFrame(rows, "delivery long, ts timestamp, event_id long, part int"))
    assert sorted((r.delivery, r.event_id) for r in batch.collect()) == [(i, i) for i in range(7)]


def test_states_of_jobs_and_failures(spark):
    jobs = spark.createDataFrame([(1, "DEAD_LETTER", 3), (2, "DEAD_LETTER", 3), (3, "RUNNING", 1)], "job long, status string, attempts int")
    again = state.retried(jobs, jobs.where("job <> 2")).orderBy("job").collect()
    assert [tuple(r) for r in again] == [(1, "QUEUED", 0), (2, "DEAD_LETTER", 3), (3, "RUNNING", 1)]
    rows = spark.createDataFrame([("NETWORK_ERROR", None), (None, 503), (None, 429), ("EMPTY_REPOSITORY", 200), ("X", 404), (None, None)], "code string, status int")
    found = rows.select(state.is_retryable(F.col("code"), F.col("status")), state.is_deterministic(F.col("code"), F.col("status"))).collect()
    assert [tuple(r) for r in found] == [(True, False), (True, False), (True, False), (False, True), (False, True), (False, False)]
