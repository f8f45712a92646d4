"""Jobs and request limits whose state ends: arbitrary state with timers and time to live, and the same in batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ripplet.sources.scratch import discard, written

#: The states of a job that other enqueues of its key wait for.
ACTIVE = ("QUEUED", "RUNNING", "RETRYING")
#: The state store that arbitrary state with timers needs; set it as spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ENQUEUED = "key string, event_id long, job string, deduped boolean"
LIMITED = "client long, event_id long, allowed boolean, remaining long, retry_after long"


class _ActiveJob(StatefulProcessor):
    """Keeps a key's active job until it ends, or until event time is so far beyond the last news of it."""

    def __init__(self, hours: float) -> None:
        self.live = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "job string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job, timer = self.active.get() if self.active.exists() else (None, None)
        out, last = [], 0
        for event, enqueue, name, status, ts in pd.concat(rows).sort_values(["ts", "event_id"])[["event_id", "enqueue", "job", "status", "ts"]].itertuples(index=False):
            last = int(ts.timestamp() * 1000)
            if enqueue:
                out.append((key[0], event, name if job is None else job, job is not None))
                job = name if job is None else job
            elif job is not None and (name is None or name == job) and status not in ACTIVE:
                job = None
        if timer is not None:
            self.handle.deleteTimer(timer)
        if job is None:
            self.active.clear()
        else:
            self.handle.registerTimer(last + self.live)
            self.active.update((job, last + self.live))
        yield pd.DataFrame(out, columns=["key", "event_id", "job", "deduped"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.active.clear()
        yield pd.DataFrame({"key": [], "event_id": [], "job": [], "deduped": []}).astype({"key": "object", "event_id": "int64", "job": "object", "deduped": "bool"})

    def close(self) -> None:
        pass


def stream_enqueued(events: DataFrame, hours: float = 24, late: str = "1 minute") -> DataFrame:
    """key, event_id, job, deduped of each enqueue in a stream of events (key, ts, event_id, enqueue, job, status).

    An enqueue starts the job that it names, unless a job of its key is active: then it gets that one. A status other than QUEUED,
    RUNNING, RETRYING ends the key's job; it names the job, or none for whichever is active. Events without a key aren't
    held against others: each is a job of its own. A key's state ends with its job, or when the
    watermark is `hours` beyond the last news of it, by a timer of event time. Events of a key are taken in order of time within a micro-batch, which bounds what is held for a key.
    """
    keyed = events.withWatermark("ts", late).where("key is not null").groupBy("key")
    held = keyed.transformWithStateInPandas(_ActiveJob(hours), ENQUEUED, "Append", "EventTime")
    return held.unionByName(_free(events))


def _free(events: DataFrame) -> DataFrame:
    return events.where("key is null and enqueue").select("key", "event_id", "job", F.lit(False).alias("deduped"))


def enqueued(events: DataFrame) -> DataFrame:
    """The batch form of stream_enqueued(): the first enqueue after a key's last ended job starts a job, those that follow get it.
    Of several ends that name one job the first counts. Windows go over one key's events."""
    named = F.row_number().over(Window.partitionBy("key", "job").orderBy("ts", "event_id"))
    over = F.when(~F.col("enqueue") & ~F.col("status").isin(*ACTIVE), True).otherwise(F.col("status").isNull() & ~F.col("enqueue"))
    ends = events.where(F.col("key").isNotNull() & over).withColumn("nth", named).where("job is null or nth = 1")
    rows = ends.select("key", "ts", "event_id", F.lit(1).alias("end"), F.lit(None).cast("string").alias("job"))
    rows = rows.unionByName(events.where("key is not null and enqueue").select("key", "ts", "event_id", F.lit(0).alias("end"), "job"))
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    turns = rows.withColumn("turn", F.sum("end").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("end = 0")
    turn = Window.partitionBy("key", "turn").orderBy("ts", "event_id")
    first = F.first("job").over(turn.rowsBetween(Window.unboundedPreceding, 0))
    done = turns.select("key", "event_id", first.alias("job"), (F.row_number().over(turn) > 1).alias("deduped"))
    return done.unionByName(_free(events))


#: Fields of a job that an update can set or clear, and those that it can only set.
CLEARABLE = ("last_error", "phase", "started_at", "finished_at", "result", "commit_sha")
KEPT = ("status", "attempts")


def job_records(created: DataFrame, updates: DataFrame) -> DataFrame:
    """Each created job (job, ts and the fields) after its updates (job, ts, event_id, cleared and the fields): a null field stays
    as it is, one that is named in cleared (an array) becomes null, any other value replaces. Status and attempts can't be cleared;
    updates of unknown jobs, and those before a job was created, are left out. One aggregate a job, whatever their number."""
    fields = [c for c in (*KEPT, *CLEARABLE) if c in created.columns]
    none = F.lit(None)
    first = created.select("job", "ts", none.cast("long").alias("event_id"), none.cast("array<string>").alias("cleared"), F.col("ts").alias("created_at"), *fields)
    known = updates.join(created.select("job", F.col("ts").alias("created_at")), "job").where("ts >= created_at")
    rows = first.unionByName(known.select(*first.columns))
    order = F.struct("ts", F.coalesce("event_id", F.lit(-1)))

    def last(name: str) -> Column:
        gone = F.coalesce(F.array_contains("cleared", F.lit(name)), F.lit(False)) if name in CLEARABLE else F.lit(False)
        told = F.col(name).isNotNull() | gone
        return F.max_by(F.struct(F.when(~gone, F.col(name)).alias("v")), F.when(told, order))["v"].alias(name)

    return rows.groupBy("job").agg(F.min("created_at").alias("created_at"), F.max("ts").alias("updated_at"), *[last(c) for c in fields])


class _Window(StatefulProcessor):
    """A client's window: opened by its first request, gone as soon as event time has passed its end."""

    def __init__(self, limit: int, seconds: float) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "reset double, used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.window.get() if self.window.exists() else None
        reset, used = before or (None, 0)
        out = []
        for event, ts in pd.concat(rows).sort_values(["ts", "event_id"])[["event_id", "ts"]].itertuples(index=False):
            now = ts.timestamp()
            if reset is None or reset <= now:
                reset, used = now + self.seconds, 0
            allowed = used < self.limit
            used += allowed
            out.append((key[0], event, allowed, self.limit - used if allowed else 0, 0 if allowed else max(1, math.ceil(reset - now))))
        if before:
            self.handle.deleteTimer(int(before[0] * 1000))
        self.handle.registerTimer(int(reset * 1000))
        self.window.update((reset, used))
        yield pd.DataFrame(out, columns=["client", "event_id", "allowed", "remaining", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.window.clear()
        yield pd.DataFrame({"client": [], "event_id": [], "allowed": [], "remaining": [], "retry_after": []}).astype({"client": "int64", "event_id": "int64", "allowed": "bool", "remaining": "int64", "retry_after": "int64"})

    def close(self) -> None:
        pass


def stream_limited(requests: DataFrame, limit: int = 10, seconds: float = 60, late: str = "10 seconds") -> DataFrame:
    """client, event_id, allowed, remaining, retry_after of requests (client, ts, event_id): at most `limit` in a window of so many
    seconds that a client's first request opens; retry_after is in whole seconds, 1 at least. A window's state goes when the
    watermark passes its end: a timer of event time, so clients that are never heard of again leave nothing."""
    keyed = requests.withWatermark("ts", late).groupBy("client")
    return keyed.transformWithStateInPandas(_Window(limit, seconds), LIMITED, "Append", "EventTime")


def limited(requests: DataFrame, limit: int = 10, seconds: float = 60) -> DataFrame:
    """The batch form of stream_limited(). A window begins at a client's first request, the next one at the first request after
    its end. Where each moment's next window would begin is a range window; which of these moments are begins is found by
    doubling the steps from the first, in as many joins as the logarithm of the windows. Windows go over one client's rows."""
    at, span = F.unix_micros(F.col("ts").cast("timestamp")), round(seconds * 1_000_000)
    rows = written(requests.select("client", "event_id", at.alias("at")), "requests")
    moments = rows.select("client", "at").distinct()
    ahead = Window.partitionBy("client").orderBy("at").rangeBetween(span, Window.unboundedFollowing)
    jump = written(moments.withColumn("next", F.min("at").over(ahead)), "jump")
    begins = written(moments.groupBy("client").agg(F.min("at").alias("at")), "begins")
    while True:
        new = begins.join(jump, ["client", "at"]).where("next is not null").select("client", F.col("next").alias("at"))
        if not new.limit(1).count():
            break
        before, begins = begins, written(begins.unionByName(new).distinct(), "begins")
        far = jump.where("next is not null").join(jump.select("client", F.col("at").alias("next"), F.col("next").alias("far")), ["client", "next"])
        old, jump = jump, written(far.select("client", "at", F.col("far").alias("next")), "jump")
        discard(before, old)
    marked = rows.join(begins.withColumn("begin", F.col("at")), ["client", "at"], "left")
    order = Window.partitionBy("client").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    opened = marked.withColumn("opened", F.last("begin", ignorenulls=True).over(order))
    nth = F.row_number().over(Window.partitionBy("client", "opened").orderBy("at", "event_id"))
    left = F.greatest(F.lit(1), F.ceil((F.col("opened") + span - F.col("at")) / 1_000_000))
    done = opened.withColumn("nth", nth).select(
        "client",
        "event_id",
        (F.col("nth") <= limit).alias("allowed"),
        F.greatest(F.lit(0), limit - F.col("nth")).cast("long").alias("remaining"),
        F.when(F.col("nth") <= limit, 0).otherwise(left).cast("long").alias("retry_after"),
    )
    return done
