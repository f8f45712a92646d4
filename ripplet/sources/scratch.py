"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes the shuffle files of a write as soon as it has ended.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without one a local session, whose tasks are threads, gets a folder of its own; on a
    cluster there is nowhere that all executors can read, which is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or f"file:///tmp/checkpoints/ripplet-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read again: what follows neither computes them again
    nor depends on the executors that did."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SWEEP)
    spark.conf.set(SWEEP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SWEEP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame | None) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in frames:
        if df is None:
            continue
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
