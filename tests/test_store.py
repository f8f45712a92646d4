"""Upserts and appends: each batch once, untouched buckets as they were."""

import glob

import pytest

from ripplet.operators import tables
from ripplet.sources.store import Store

SCHEMA = "id string, seq long, note string"


def rows(spark, *some):
    return spark.createDataFrame(list(some), SCHEMA)


def content(store):
    return sorted(tuple(r) for r in store.read().collect())


def test_an_upsert_puts_in_the_newest_row_of_a_key(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t", "id", 8)
    with pytest.raises(ValueError):
        store.read()
    assert store.upsert(rows(spark, *[(f"k{i}", i, "old") for i in range(40)], ("k1", 99, "newer"), (None, 1, "no key")), ["seq"])
    assert len(content(store)) == 40 and ("k1", 99, "newer") in content(store)
    before = store.version()["folders"]
    assert store.upsert(rows(spark, ("k2", 1, "new"), ("k2", 0, "not this"), ("fresh", 5, None)), ["seq"])
    after = store.version()["folders"]
    assert len(content(store)) == 41 and ("k2", 1, "new") in content(store) and ("fresh", 5, None) in content(store)
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and all(after[b] == before[b] for b in before if b not in changed)
    here = content(store)
    store.clean()
    assert content(store) == here and len(glob.glob(f"{tmp_path}/t/data/*/__bucket=*")) == len(after)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t", "id", 4)
    assert store.upsert(rows(spark, ("a", 1, "x")), ["seq"], "s", 0)
    assert store.upsert(rows(spark, ("a", 2, "y")), ["seq"], "s", 1)
    here, version = content(store), store.version()
    assert not store.upsert(rows(spark, ("a", 1, "x")), ["seq"], "s", 0) and not store.upsert(rows(spark, ("a", 9, "z")), ["seq"], "s", 1)
    assert content(store) == here == [("a", 2, "y")] and store.version() == version
    assert store.upsert(rows(spark, ("b", 1, None)), ["seq"], "other", 0) and len(content(store)) == 2


def test_two_writers_of_one_version_end_in_an_error(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t", "id", 4)
    store.upsert(rows(spark, ("a", 1, "x")), ["seq"])
    stale = store.version()
    store.upsert(rows(spark, ("b", 1, "x")), ["seq"])
    with pytest.raises(RuntimeError):
        store._commit(stale | {"number": stale["number"] + 1})
    assert len(content(store)) == 2


def test_a_stream_is_written_once_over_a_restart(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t", "id", 4)
    for i in range(3):
        rows(spark, (f"k{i}", i, "x"), ("all", i, f"batch {i}")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for folder in ("check", "lost"):  # the second run has lost its checkpoint and sends all batches again
        query = stream.writeStream.foreachBatch(store.sink("in", ["seq"])).option("checkpointLocation", f"{tmp_path}/{folder}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None and store.version()["number"] == 3
    assert content(store) == [("all", 2, "batch 2"), ("k0", 0, "x"), ("k1", 1, "x"), ("k2", 2, "x")]


def test_history_is_appended_without_runs_that_are_known(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t", "repo", 4)
    run = lambda *some: spark.createDataFrame(list(some), "repo long, sha string")
    unseen = lambda old, new: tables.new_runs(old, new, ("repo", "sha"))
    store.append(run((1, "x"), (1, None)), unseen, "s", 0)
    store.append(run((1, "x"), (1, None), (2, "x")), unseen, "s", 1)
    store.append(run((1, "y")), unseen, "s", 1)
    assert sorted(map(tuple, store.read().collect()), key=str) == [(1, "x"), (1, None), (1, None), (2, "x")]
