"""Deliveries, limits and jobs: batch forms that streams share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_deliveries(events: DataFrame) -> DataFrame:
    """The first event of each delivery (delivery, ts, event_id); later ones are duplicates."""
    rest = [c for c in events.columns if c != "delivery"]
    return events.groupBy("delivery").agg(F.min_by(F.struct(*rest), F.struct("ts", "event_id")).alias("e")).select("delivery", "e.*")


def stream_first_deliveries(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same on a stream: a delivery is remembered until the watermark has passed it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["delivery"])


def retry_job(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Each job's state after its attempts (job, ts, event_id, ok, retryable): SUCCEEDED, RETRYING or DEAD_LETTER. An error
    that isn't known to be worth another try (retryable is null) is a dead letter."""
    key = F.struct("ts", "event_id")
    row = attempts.groupBy("job").agg(F.count("*").alias("attempts"), F.max_by("ok", key).alias("ok"), F.max_by("retryable", key).alias("retryable"))
    return row.select("job", "attempts", F.when(F.col("ok"), "SUCCEEDED").when(~F.col("retryable") | (F.col("attempts") >= most), "DEAD_LETTER").otherwise("RETRYING").alias("status"))


#: Errors that are worth another try, and errors that come again.
RETRYABLE = ("ANALYSIS_TIMEOUT", "GITHUB_RATE_LIMITED", "QUEUE_UNAVAILABLE", "DATABASE_UNAVAILABLE", "NETWORK_ERROR", "CLONE_FAILED_TRANSIENT")
DETERMINISTIC = (
    "INVALID_REPOSITORY_URL",
    "PRIVATE_REPOSITORY",
    "ACCESS_DENIED",
    "REPOSITORY_NOT_FOUND",
    "REPOSITORY_TOO_LARGE",
    "UNSUPPORTED_REPOSITORY",
    "FILE_LIMIT_EXCEEDED",
    "GRAPH_LIMIT_EXCEEDED",
    "EMPTY_REPOSITORY",
    "NO_SUPPORTED_FILES",
    "INVALID_REQUEST",
)


def is_retryable(code: Column, status: Column) -> Column:
    return F.coalesce((status >= 500) | (status == 429), F.lit(False)) | F.coalesce(code.isin(*RETRYABLE), F.lit(False))


def is_deterministic(code: Column, status: Column) -> Column:
    return F.coalesce(status.isin(401, 403, 404), F.lit(False)) | F.coalesce(code.isin(*DETERMINISTIC), F.lit(False))


def delivery_states(events: DataFrame) -> DataFrame:
    """(delivery, status, processed_at): the newest status of each delivery; processed_at only if it is final."""
    newest = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id"))
    row = events.groupBy("delivery").agg(newest.alias("e"))
    final = F.col("e.status").isin("completed", "failed")
    return row.select("delivery", "e.status", F.when(final, F.col("e.ts")).alias("processed_at"))


def queue_depth(jobs: DataFrame) -> DataFrame:
    """One row: jobs by what they are doing."""
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("QUEUED", "RUNNING", "RETRYING", "SUCCEEDED", "DEAD_LETTER")])


def retried(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs with those of wanted (job) that are dead letters put in the queue again, without attempts."""
    asked = jobs.join(wanted.select("job", F.lit(True).alias("__again")).distinct(), "job", "left")
    again = F.coalesce("__again", F.lit(False)) & (F.col("status") == "DEAD_LETTER")
    reset = {"status": F.when(again, "QUEUED").otherwise(F.col("status")), "attempts": F.when(again, 0).otherwise(F.col("attempts"))}
    return asked.withColumns(reset).drop("__again")


def retained(jobs: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Jobs (status, updated_at) without the ended ones of more than so many days ago."""
    old = F.col("updated_at") < now - F.make_dt_interval(F.lit(days))
    return jobs.where(~(F.col("status").isin("SUCCEEDED", "DEAD_LETTER") & old))


def cached(analyses: DataFrame, now: Column, version: int) -> DataFrame:
    """The newest analysis of each identity (repository, sha) of the version that hasn't expired; a null expiry never does."""
    live = analyses.where((F.col("version") == version) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    rest = [c for c in live.columns if c not in ("repository", "sha")]
    newest = F.max_by(F.struct(*rest), F.struct("updated_at", "id"))
    return live.groupBy("repository", "sha").agg(newest.alias("a")).select("repository", "sha", "a.*")


def counters(samples: DataFrame) -> DataFrame:
    """Counters (name, labels, value) summed by name and labels, whatever the order of the labels (a map)."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return samples.groupBy("name", labels.alias("labels")).agg(F.sum("value").alias("value"))
