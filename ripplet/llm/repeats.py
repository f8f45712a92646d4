"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash of TRIGGER bytes that is 0 modulo PHRASE is a trigger; triggers cut every text into phrases, each from a
trigger to the end of the next one, so that equal strings are parsed alike wherever they stand. The starts of windows of
`width` bytes fall into segments: runs of starts whose windows begin in one phrase and end in one phrase. A segment has two
names (hashes): the inner one of the whole phrases that all its windows hold, and the outer one of the string that its
windows cover.

Corpus order is built from the parse as far as the question needs it: windows that are equal are neighbours in any
order of the suffixes, and they have one inner name. So segments are brought together by inner name (the parse's suffixes
that agree on their whole phrases), and those whose inner name is single are settled: no window of theirs repeats.
Segments with one outer name repeat as a whole. Where one inner name has several outer ones, the copies leave each other
inside the first or the last phrase; there the windows of one segment for each outer name (the dictionary's entry) are
told apart, in runs of neighbouring starts as long as a run's common string is single, then start by start. A name is an order-less rank: unlike a lexicographic one it needs no sort over all suffixes,
and equal names stand for equal strings just as equal ranks do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import discard, written
from ripplet.llm.encoding import portions

TRIGGER, PHRASE_BITS, WEAK = 16, 6, 128
#: Odd multipliers of the two polynomial hashes modulo 2**64; letters are replaced by random odd numbers first.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_letters = [np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 12)]
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The first n powers of each base and of its inverse modulo 2**64."""
    global _powers
    if not _powers or len(_powers[0][0]) < n:
        _powers = []
        for base in BASES:
            pair = []
            for step in (base, pow(base, -1, 2**64)):
                x = np.full(max(n, 1 << 16), step, np.uint64)
                x[0] = 1
                pair.append(np.multiply.accumulate(x))
            _powers.append(tuple(pair))
    return _powers


class Bytes:
    """Hashes of any strings of a buffer, by prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = []
        for (up, _), letters in zip(_power(n + 1), _letters, strict=True):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(letters[data] * up[:n], out=s[1:])
            self.sums.append(s)

    def name(self, k: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        s, (_, down) = self.sums[k], _powers[k]
        x = (s[stop] - s[start]) * down[start]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def segments(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(start, number of starts, inner name, outer name, bare, inner start less start) of the segments of texts that stand
    one after another in data and end at ends. bare: no trigger in the windows, so nothing settles them but their bytes."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, bool, np.int64))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    last = ends - width  # the last start of each text
    some = last >= starts
    if not some.any():
        return empty
    text = Bytes(data)
    here = np.arange(len(data) - TRIGGER + 1)
    trigger = here[text.name(0, here, here + TRIGGER) >> np.uint64(64 - PHRASE_BITS) == 0]
    owner = np.searchsorted(ends, trigger, "right")
    trigger = trigger[trigger + TRIGGER <= ends[owner]]  # not over a text's end

    def settled(cuts: np.ndarray) -> tuple[np.ndarray, ...]:
        p = np.unique(cuts)
        of = np.searchsorted(ends, p, "right")
        of = np.minimum(of, len(ends) - 1)
        ok = (p >= starts[of]) & (p <= last[of]) & (p >= 0)
        p, of = p[ok], of[ok]
        stop = np.minimum(np.concatenate([p[1:], [len(data)]]), last[of] + 1)
        first = np.searchsorted(trigger, p)  # of the triggers in the windows
        after = np.searchsorted(trigger, p + (width - TRIGGER), "right")
        return p, stop, first, after

    cuts = np.concatenate([starts[some], trigger + 1, trigger + TRIGGER - width])
    p, stop, first, after = settled(cuts)
    if not len(trigger):
        bare = np.ones(len(p), bool)
        inner = outer = text.name(1, p, stop - 1 + width)
        return p, stop - p, inner, outer, bare, np.zeros(len(p), np.int64)
    lead = trigger[np.minimum(first, len(trigger) - 1)]
    tail = trigger[np.maximum(after - 1, 0)] + TRIGGER
    weak = (after > first) & (tail - lead < WEAK)
    half = width // 2
    p, stop, first, after = settled(np.concatenate([cuts, lead[weak] - half]))
    lead = trigger[np.minimum(first, len(trigger) - 1)]
    tail = trigger[np.maximum(after - 1, 0)] + TRIGGER
    bare = after <= first
    weak = ~bare & (tail - lead < WEAK)
    right = lead - p <= half
    a = np.where(weak & ~right, lead - half, lead)
    b = np.where(weak, np.where(right, lead + half, lead), tail)
    a, b = np.where(bare, p, a), np.where(bare, stop - 1 + width, b)
    outer = text.name(1, p, stop - 1 + width)
    return p, stop - p, text.name(0, a, b), outer, bare, a - p


def _buffer(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(x or "").encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])


def _parse(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in portions(texts):
                data, ends = _buffer(texts[part])
                p, n, inner, outer, bare, lead = segments(data, ends, width)
                of = np.searchsorted(ends, p, "right")
                at = p - np.concatenate([[0], ends])[of]
                names = [pa.array(inner.view(np.int64)), pa.array(outer.view(np.int64)), pa.array(bare)]
                places = [pa.array(k1[part][of]), pa.array(k2[part][of]), *[pa.array(x.astype(np.int32)) for x in (at, n, lead)]]
                yield pa.RecordBatch.from_arrays([*names, *places], ["inner", "outer", "bare", "k1", "k2", "at", "n", "lead"])

    return parse


#: Windows whose starts differ by fewer bytes go together as long as nothing tells that they repeat.
RUN = 8


def _runs(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From text and segments (at, n, lead, bare, entry, times) to a row for each run of starts: the two names of what all
    its windows hold, its first start in the segment and the number of its starts. Runs are counted from the inner string,
    which equal windows hold at one place; the windows of a bare segment are runs of their own."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, segs in zip(batch.column(0), batch.column(1), strict=True):
                text = Bytes(np.frombuffer((raw.as_py() or "").encode(), np.uint8))
                s = {f: segs.values.field(f).to_numpy(zero_copy_only=False) for f in ("at", "n", "lead", "bare", "entry", "times")}
                n = s["n"].astype(np.int64)
                of = np.repeat(np.arange(len(n)), n)
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p = s["at"].astype(np.int64)[of] + off
                bare = s["bare"][of]
                run = np.where(bare, off, (s["lead"][of] - off) // RUN)
                new = np.concatenate([[True], (of[1:] != of[:-1]) | (run[1:] != run[:-1])])
                first = np.flatnonzero(new)
                left = np.where(bare, p, s["at"].astype(np.int64)[of] + s["lead"][of] - RUN * run)[first]
                right = np.where(bare[first], left + width, left - RUN + 1 + width)
                cores = [pa.array(text.name(k, left, right).view(np.int64)) for k in (0, 1)]
                places = [pa.array(x.astype(np.int32)) for x in (off[first], np.diff(np.append(first, len(p))))]
                rest = [pa.array(s["entry"][of][first]), pa.array(s["times"][of][first]), *places]
                yield pa.RecordBatch.from_arrays([*cores, *rest], ["a", "b", "entry", "times", "off", "n"])

    return runs


def _starts(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From text and runs (at, n, entry, times, off) to a row for each window: its two names and its place in the segment."""

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, runs in zip(batch.column(0), batch.column(1), strict=True):
                text = Bytes(np.frombuffer((raw.as_py() or "").encode(), np.uint8))
                s = {f: runs.values.field(f).to_numpy(zero_copy_only=False) for f in ("at", "n", "entry", "times", "off")}
                n = s["n"].astype(np.int64)
                of = np.repeat(np.arange(len(n)), n)
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p = s["at"].astype(np.int64)[of] + inside
                names = [pa.array(text.name(k, p, p + width).view(np.int64)) for k in (0, 1)]
                rest = [pa.array(s["entry"][of]), pa.array(s["times"][of]), pa.array((s["off"][of] + inside).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*names, *rest], ["a", "b", "entry", "times", "off"])

    return starts


def cover(size: int, at: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """The maximal runs (start, stop) that windows at starts at .. at + n - 1 cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n - 1 + width, -1)
    inside = np.concatenate([[False], np.cumsum(edge)[:size] > 0, [False]])
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


def _remove(width: int, texts_too: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (raw or "").encode()
                runs = []
                if found.is_valid:
                    runs = cover(len(data), found.values.field("at").to_numpy().astype(np.int64), found.values.field("n").to_numpy().astype(np.int64), width).tolist()
                kept = b"".join(data[i:j] for i, j in zip([0, *[r[1] for r in runs]], [*[r[0] for r in runs], len(data)], strict=True)) if runs else data
                rows.append((doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": i, "stop": j} for i, j in runs], kept if texts_too else None))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return remove


def _repeated(rows: DataFrame) -> DataFrame:
    """Those of the rows (a, b, times, ...) whose names (a, b) others have too or that stand for several segments."""
    rows = rows.repartition("a", "b")  # dealt out once, for the groups and for the rows
    several = rows.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("times").alias("m")).where("c > 1 or m > 1")
    return rows.join(several.select("a", "b"), ["a", "b"], "left_semi")


def remove_repeats(docs: DataFrame, width: int = 400, with_bytes: bool = False) -> DataFrame:
    """Removes each byte that a string of `width` bytes covers which also starts anywhere else in the corpus.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop in bytes), and kept (the bytes left;
    null unless with_bytes). A null text is an empty one; a text shorter than `width` stays whole. Rows repeated with
    doc_id and text count as copies of each other. Null doc_ids are kept, very long texts are parsed whole; other columns
    are ignored; no rows give none. Equality is that of names: two 64-bit hashes for rows and windows; segments that repeat
    as a whole agree in an inner and an outer 64-bit hash (one in bare ones).

    No shuffle holds a window or a text more than once: segments (about 2 for every 64 bytes) are counted by inner name
    with partial sums, and only those with a repeated one go on; windows that can't be settled so are first told apart in
    runs of RUN, then one by one.
    """
    ident = {"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(7), "doc_id", "text")}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(ident)
    place = ("k1", "k2", "at", "n", "lead", "bare")
    schema = "inner long, outer long, bare boolean, k1 long, k2 long, at int, n int, lead int"
    parse = written(rows.select("k1", "k2", "text").mapInArrow(_parse(width), schema), "parse")
    again = parse.where("not bare").groupBy("inner").count().where("count > 1").select("inner")
    found = written(parse.where("not bare").join(again, "inner", "left_semi").unionByName(parse.where("bare")), "segments")
    discard(parse)
    # The dictionary: one entry for each outer name, with its first place.
    entries = found.groupBy("inner", "outer").agg(F.count("*").alias("times"), F.min(F.struct(*place)).alias("first"))
    entries = written(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
    several = entries.groupBy("inner").agg(F.min("outer").alias("lo"), F.max("outer").alias("hi")).where("lo < hi").select("inner")
    open_ = entries.join(several, "inner", "left_semi").union(entries.where("first.bare").join(several, "inner", "left_anti"))

    def texts(places: DataFrame, *place: str) -> DataFrame:
        """Each text with the list of its places (k1, k2, ...)."""
        lists = places.groupBy("k1", "k2").agg(F.collect_list(F.struct(*place)).alias("places"))
        return rows.join(lists, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("text", "places")

    seg = ("at", "n", "lead", "bare", "entry", "times")
    runs = texts(open_.select("first.*", "entry", "times"), *seg).mapInArrow(_runs(width), "a long, b long, entry long, times long, off int, n int")
    runs = written(runs, "runs")
    # Only runs that others equal get names for each of their windows, from the texts again: those of all would be most of the disk.
    again = written(_repeated(runs).select("entry", "times", "off", "n"), "equal-runs")
    discard(runs)
    places = again.join(entries.select("entry", "first.k1", "first.k2", "first.at"), "entry").withColumn("at", F.col("at") + F.col("off"))
    starts = texts(places, "at", "n", "entry", "times", "off").mapInArrow(_starts(width), "a long, b long, entry long, times long, off int")
    starts = written(starts, "starts")
    discard(again)
    parts = written(_repeated(starts).where("times = 1").select("entry", "off"), "window-starts")
    discard(starts)
    partly = parts.join(entries.select("entry", "first"), "entry")
    partly = partly.select("first.k1", "first.k2", (F.col("first.at") + F.col("off")).alias("at"), F.lit(1).alias("n"))
    whole = found.join(entries.where("times > 1").select("inner", "outer"), ["inner", "outer"], "left_semi").select("k1", "k2", "at", "n")
    # Rows that are equal in doc_id and text have the same places: once, before they meet, so that no list grows with their number.
    spans = whole.union(partly).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>, kept binary"
    return rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "found").mapInArrow(_remove(width, with_bytes), result)
