"""A stored table that takes upserts and appends by buckets of its key, each batch once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ripplet.sources.scratch import discard, written

BUCKET = "__bucket"


class Store:
    """The table at a path. A version is one small file that names the folders of each bucket; it is put in place by a rename, so
    readers see a version whole or not at all. A batch rewrites the buckets that it touches and leaves the others' files as they
    are. Versions remember the last batch of each source: one that comes again, after a restart, changes nothing. Writers come one
    after the other, as those of one streaming query do; a second one at the same time ends in an error.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _at(self, *parts: str) -> JavaObject:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self) -> JavaObject:
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> dict:
        """The newest version: number, schema, folders of each bucket, last batch of each source."""
        files, folder = self._files(), self._at("versions")
        numbers = [int(x.getPath().getName()[:-5]) for x in files.listStatus(folder) if x.getPath().getName().endswith(".json")] if files.exists(folder) else []
        if not numbers:
            return {"number": 0, "schema": None, "folders": {}, "batches": {}}
        (row,) = self.spark.read.option("wholetext", True).text(self._at("versions", f"{max(numbers):012}.json").toString()).collect()
        return json.loads(row[0])

    def _commit(self, version: dict) -> None:
        files, target = self._files(), self._at("versions", f"{version['number']:012}.json")
        draft = self._at("versions", f"draft-{uuid.uuid4().hex}")
        stream = files.create(draft, True)
        stream.write(bytearray(json.dumps(version), "utf-8"))
        stream.close()
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise RuntimeError(f"somebody else has written version {version['number']} of {self.path}")

    def read(self) -> DataFrame:
        """All rows of the newest version."""
        version = self.version()
        if not version["schema"]:
            raise ValueError(f"nothing was written to {self.path}")
        return self._rows(version, version["folders"])

    def _rows(self, version: dict, buckets: list[str] | dict) -> DataFrame:
        schema = StructType.fromJson(version["schema"])
        folders = [f for b in buckets for f in version["folders"].get(b, [])]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).alias(BUCKET)

    def _write(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], replaces: bool, source: str | None, batch: int | None) -> bool:
        version = self.version()
        if source is not None and batch <= version["batches"].get(source, -1):
            return False
        new = written(rows.where(F.col(self.key).isNotNull()), "batch")
        touched = [str(r[0]) for r in new.select(self._bucket()).distinct().collect()]  # a number for each bucket at most
        if not version["schema"]:
            version["schema"] = json.loads(rows.schema.json())
        done = merge(new.select(*StructType.fromJson(version["schema"]).names), self._rows(version, touched))
        folder = f"data/{uuid.uuid4().hex}"
        done.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        for x in self._files().listStatus(self._at(folder)):
            name = x.getPath().getName()
            if name.startswith(f"{BUCKET}="):
                b = name.partition("=")[2]
                version["folders"][b] = ([] if replaces else version["folders"].get(b, [])) + [f"{folder}/{name}"]
        version["number"] += 1
        if source is not None:
            version["batches"][source] = batch
        self._commit(version)
        discard(new)
        return True

    def upsert(self, rows: DataFrame, order: list[str], source: str | None = None, batch: int | None = None) -> bool:
        """Puts in the newest row (by order) of each key in place of the one there is. Rows without a key are left out. False if the
        batch of the source was written before."""

        def merge(new: DataFrame, old: DataFrame) -> DataFrame:
            last = F.max_by(F.struct(*new.columns), F.struct(*order)).alias("r")
            latest = new.groupBy(F.col(self.key).alias("__key")).agg(last).select("r.*")
            return latest.unionByName(old.join(latest.select(self.key), self.key, "left_anti"))

        return self._write(rows, merge, True, source, batch)

    def append(self, rows: DataFrame, unseen: Callable[[DataFrame, DataFrame], DataFrame] | None = None, source: str | None = None, batch: int | None = None) -> bool:
        """Adds rows; unseen(old, new) leaves out those that the key's stored rows make known (tables.new_runs)."""
        return self._write(rows, lambda new, old: unseen(old, new) if unseen else new, False, source, batch)

    def sink(self, source: str, order: list[str]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: upserts each micro-batch once, whatever is run again."""

        def put(rows: DataFrame, batch: int) -> None:
            self.upsert(rows, order, source, batch)

        return put

    def clean(self) -> None:
        """Deletes what the newest version doesn't name; readers of older versions must be done."""
        kept = {f for some in self.version()["folders"].values() for f in some}
        files = self._files()
        for run in files.listStatus(self._at("data")):
            for x in files.listStatus(run.getPath()):
                if x.isDirectory() and f"data/{run.getPath().getName()}/{x.getPath().getName()}" not in kept:
                    files.delete(x.getPath(), True)
