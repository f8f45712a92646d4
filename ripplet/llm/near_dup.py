"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.candidates import across, bounded, reach, shared, star
from ripplet.llm.common import discard, written
from ripplet.llm.components import components
from ripplet.llm.encoding import portions

_U = np.uint64
#: In mixed buckets of at most so many members all pairs of different components are compared.
SMALL = 16


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a whole text as sorted 64-bit hashes: A-Z in lower case, words without white
    space. Fewer words make one shingle, none none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), _U)
    for j in range(min(k, len(h))):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (float32, m a set) of non-empty sets, for all of them at once.

    An element's j-th step offers j + r, r uniform in [0, 1), to the slot at place j of its own random permutation of the
    slots, which is drawn step by step. The steps of all elements go on side by side; a set leaves when its largest
    value is below the next step, as then no later offer can lower any slot.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets) * m, np.inf, np.float32)
    x = np.concatenate(sets) if sets else np.zeros(0, _U)
    of = np.repeat(np.arange(len(sets)), sizes)
    slots = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
    for j in range(m):
        if not len(x):
            break
        x = _mix(x + _U(0x9E3779B97F4A7C15))
        r = ((x >> _U(40)).astype(np.float32) * np.float32(2**-24)).clip(max=np.float32(1 - 2**-24))
        k = j + ((x & _U(0xFFFFFFFF)) * _U(m - j) >> _U(32)).astype(np.int64)
        row = np.arange(len(x))
        chosen = slots[row, k]
        slots[row, k] = slots[:, j]
        slots[:, j] = chosen
        np.minimum.at(out, of * m + chosen, r + np.float32(j))
        if j + 1 < m:
            going = out.reshape(-1, m).max(1) > j + 1
            stay = going[of]
            if not stay.all():
                x, of, slots = x[stay], of[stay], slots[stay]
    return out.reshape(len(sets), m)


def _sign(k: int, m: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in portions(texts, 150_000):
                sets = [shingles(t, k) for t in texts[part]]
                full = [s for s in sets if len(s)]
                bits = super_minhash(full, m).view(np.uint32).astype(_U).reshape(len(full), m // rows, rows)
                keys = np.tile(np.arange(m // rows, dtype=_U), (len(full), 1))
                for r in range(rows):
                    keys = _mix(keys * _U(0x9E3779B97F4A7C15) + bits[:, :, r])
                keys = iter(keys.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids[part.start : part.stop], pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "same", "bands"],
                )

    return sign


def _verify(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, _U))
        for batch in batches:
            a, b, s, t = (c.to_pylist() for c in batch.columns)
            ok = []
            for key, x, y in zip(b, s, t, strict=True):
                if last[0] != key:
                    last = (key, shingles(y, k))
                p, q = shingles(x, k), last[1]
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_pydict({"a": [x for x, o in zip(a, ok, strict=True) if o], "b": [x for x, o in zip(b, ok, strict=True) if o]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return verify


def _grams(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for part in portions(texts):
                sets = [shingles(t, k) for t in texts[part]]
                of = np.repeat(nodes[part], [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate(sets).view(np.int64))], ["node", "gram"])

    return grams


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, bands: int = 32, rows: int = 6) -> DataFrame:
    """Groups documents whose sets of k-word shingles have a Jaccard similarity of at least percent / 100.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable over links), kept (the first row of its group by
    doc_id). Null and empty texts, or such of white space, have no shingles and stand alone. Rows with a null doc_id take
    part like others and come last in their group; component_id is null if the group has no other rows. Rows that repeat a
    doc_id each get a row and the links of their own text; one of a group is kept. Very long texts are compared whole.
    Other columns are ignored; no rows give none.
    """
    keyed = written(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "keyed")
    named, first = _first_rows(keyed, k, percent, bands, rows)
    done = named.join(first, "group").select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), "key", "first")
    return done.select("doc_id", "n_shingles", "component_id", (F.col("key") == F.col("first.key")).alias("kept"))


def without_copies(docs: DataFrame, k: int = 5, percent: int = 85, bands: int = 32, rows: int = 6) -> DataFrame:
    """The documents with all their columns, but of each group only the first row by doc_id. Every row has its own part in
    that, whether its doc_id is null (these come last), repeated or neither; texts are treated as in near_duplicates()."""
    keyed = written(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed")
    _, first = _first_rows(keyed.select(F.col("__key").alias("key"), "doc_id", "text"), k, percent, bands, rows)
    return keyed.join(first.select(F.col("first.key").alias("__key")), "__key", "left_semi").select(*docs.columns)


def _first_rows(keyed: DataFrame, k: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, n_shingles, group) of each row, and (group, first) with first (late, doc_id, key) of each group."""
    found = _groups(keyed.select("key", "text"), k, percent, bands, rows)
    named = written(keyed.select("key", "doc_id").join(found, "key"), "grouped")
    return named, named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("first"))


def _groups(keyed: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """key, n_shingles, group (the least key reachable) of rows (key, text) with unique keys.

    Documents with equal sets are one class. In a band's bucket all classes are compared with the least one, and the
    verified links join them to components; then the pairs of a bucket that stand in different components are compared,
    but for those that a bound rules out (candidates.across). At 85 % a pair shares none of 32 bands of 6 with
    probability 3e-7.
    """
    signed = keyed.mapInArrow(_sign(k, bands * rows, rows), "doc_id long, n_shingles long, same binary, bands array<long>")
    signed = written(signed.withColumnRenamed("doc_id", "key"), "signed")
    one = signed.where("same is not null").groupBy("same").agg(F.min("key").alias("rep"))
    classes = signed.select("key", "bands").join(one.select(F.col("rep").alias("key")), "key", "left_semi")
    members = shared(classes.select(F.col("key").alias("node"), F.explode("bands").alias("bucket")), "members")
    texts = keyed.select(F.col("key").alias("node"), "text").join(members.select("node").distinct(), "node", "left_semi")
    texts = written(texts, "member-texts")

    def alike(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.toDF("a", "s"), "a")
        full = left.join(texts.toDF("b", "t"), "b").select("a", "b", "s", "t")
        return written(full.mapInArrow(_verify(k, percent), "a long, b long"), "links")

    near = alike(star(members))
    found = components(near)
    grams = lambda some: texts.join(some, "node", "left_semi").mapInArrow(_grams(k), "node long, gram long")
    pairs = across(members, found, "near", lambda mixed: bounded(mixed, grams, percent, SMALL, "near"), lambda x, y: reach(x, y, percent))
    if pairs.limit(1).count():
        found = components(near.union(alike(pairs)))
    discard(members, texts, pairs)
    total = signed.select("key", "n_shingles", "same").join(one, "same", "left").join(found.toDF("rep", "component"), "rep", "left")
    return total.select("key", "n_shingles", F.coalesce("component", "rep", "key").alias("group"))
