"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule [^\x20\x09-\x0D]+; bytes.split() parts at just these.
SPACE = " \t\n\v\f\r"

#: Spark then deletes the shuffle files of a write as soon as it has ended.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, that of spark.checkpoint.dir. Without one a local session, whose tasks are
    threads, gets a folder of its own; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or f"file:///tmp/checkpoints/ripplet-{spark.sparkContext.applicationId}").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SWEEP)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: it cuts lineage and outlives an executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def gapless_rank(df: DataFrame, groups: list[str], order: list[Column | str], name: str, rows_per_block: int = 250) -> DataFrame:
    """Adds name: 0, 1, 2, ... within each group, whatever the size of a group.

    A group is dealt into as many hashed blocks as its rows need; a block's first number is the count of the rows in the
    blocks before it, so no task has to hold a group. The groups have to be few (shards, lengths), as their counts are
    broadcast; the blocks' counts grow with the rows, 1 for 250. df is read three times and should be a written table.
    Groups must not be null.
    """
    counts = df.groupBy(*groups).agg(F.ceil(F.count("*") / rows_per_block).alias("__blocks"))
    dealt = df.join(F.broadcast(counts), groups).withColumn("__block", F.pmod(F.xxhash64(*order), F.col("__blocks"))).drop("__blocks")
    before = Window.partitionBy(*groups).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy(*groups, "__block").count().select(*groups, "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(*groups, "__block").orderBy(*order)
    ranked = dealt.withColumn("__at", F.row_number().over(inside) - 1)
    return ranked.join(first, [*groups, "__block"]).withColumn(name, (F.col("__first") + F.col("__at")).cast("long")).drop("__block", "__first", "__at")
