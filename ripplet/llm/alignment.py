"""Aligns the tokens of two tokenizers: groups that end at the same byte, links of tokens that share bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import discard, written
from ripplet.llm.encoding import Encoder, portions, vocabulary
from ripplet.llm.pieces import PieceEncoder

#: Bytes of a text whose events are one row.
SPAN = 16_384
Batches = Iterator[pa.RecordBatch]
_encoders: dict[tuple[str, str], "Both"] = {}


def _least(most: int) -> str:
    """The smallest unsigned kind that holds a number."""
    return "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"


class Both:
    """Encodes texts with A (after a space) and B. Words between single spaces or line feeds are encoded once by both; the ids
    of a word are found by its number. The words and ids that are kept take most_bytes at most, counted with EACH."""

    EACH = 250

    def __init__(self, a_path: str, b_path: str, most_bytes: int = 200_000_000) -> None:
        self.a, self.b, self.most = Encoder(a_path, plain=True), PieceEncoder(b_path), most_bytes
        self.tokens = [self.a.token_bytes(), self.b.token_bytes()]
        self.lengths = [np.array([len(x) for x in t], np.int64) for t in self.tokens]
        self.by_words = self.a.by_words and self.b.by_parts
        self.kinds = [_least(len(n)) for n in self.lengths]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held, self.same = 0, np.zeros(0, bool)
        self.first, self.ids = [np.zeros(1, np.int64)] * 2, [np.zeros(0, "<u4")] * 2  # of each side: where a word's ids begin

    def _same(self, data: bytes, found: tuple[np.ndarray, ...]) -> bool:
        return all(b"".join(map(t.__getitem__, x.tolist())) == data for t, x in zip(self.tokens, found, strict=True))

    def _learn(self, words: list[str]) -> None:
        made = [self.a.words(words), self.b.words(words)]
        data = [w.encode() if w[0] == "\n" else b" " + w.encode() for w in words]
        whole, sizes, same = b"".join(data), np.array(list(map(len, data))), np.ones(len(words), bool)
        for side in (0, 1):
            cuts = np.cumsum([len(x) // 4 for x in made[side]])
            ids = np.frombuffer(b"".join(made[side]), "<u4")
            long = np.diff(np.append(0, np.cumsum(self.lengths[side][ids]))[cuts], prepend=0)
            if (long != sizes).any() or b"".join(map(self.tokens[side].__getitem__, ids.tolist())) != whole:
                same &= [b"".join(map(self.tokens[side].__getitem__, np.frombuffer(x, "<u4").tolist())) == d for x, d in zip(made[side], data, strict=True)]
            self.first[side] = np.concatenate([self.first[side], self.first[side][-1] + cuts])
            self.ids[side] = np.concatenate([self.ids[side], ids])
        self.same = np.concatenate([self.same, same])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.held += len(whole) + self.EACH * len(words)

    def _whole(self, text: str) -> list[np.ndarray]:
        found = [self.a.batch([f" {text}"])[0], self.b.batch([text])[0]]
        return found if self._same(b" " + text.encode(), tuple(found)) else [x[:0] for x in found]

    def batch(self, texts: list[str]) -> list[list[np.ndarray]]:
        """The ids of each text by A and by B; none where there is no text, or where either changes it."""
        parts = [self.a.plain_words(t) if self.by_words else [] for t in texts]
        new = set().union(*parts).difference(self.known)
        if new and self.held > self.most:
            self._forget()
            new = set().union(*parts)
        odd = self.a.odd(new)
        if odd:
            parts = [p if odd.isdisjoint(p) else [] for p in parts]
            new -= odd
        if new:
            self._learn(list(new))
        sizes = [len(p) for p in parts]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes))
        ends = np.cumsum(np.array(sizes, np.int64))
        sides, cuts = [], []
        for first, ids in zip(self.first, self.ids, strict=True):
            n = first[at + 1] - first[at]
            before = np.concatenate([[0], np.cumsum(n)])
            sides.append(ids[np.repeat(first[at] - before[:-1], n) + np.arange(before[-1])])
            cuts.append(before[ends])
        changed = np.append(0, np.cumsum(~self.same[at]))[ends]
        out, last = [], (0, 0, 0)
        for i, text in enumerate(texts):
            now = (int(cuts[0][i]), int(cuts[1][i]), int(changed[i]))
            if sizes[i] and now[2] == last[2]:
                out.append([x[a:b] for x, a, b in zip(sides, last, now, strict=False)])
            else:
                out.append(self._whole(text) if text else [x[:0] for x in sides])
            last = now
        return out


def _both(a_path: str, b_path: str) -> Both:
    if (a_path, b_path) not in _encoders:
        _encoders[a_path, b_path] = Both(a_path, b_path)
    return _encoders[a_path, b_path]


def _events(a_path: str, b_path: str) -> Callable[[Batches], Batches]:
    """End events of the tokens of both sides, a row for each document, span of bytes and side: the ids in order, from which the
    bytes up to each end follow."""

    def events(batches: Batches) -> Batches:
        both = _both(a_path, b_path)
        for batch in batches:
            uids, ids, texts = (c.to_pylist() for c in batch.columns)
            for part in portions(texts):
                rows: list[tuple] = []
                for uid, doc_id, found in zip(uids[part], ids[part], both.batch([t or "" for t in texts[part]]), strict=True):
                    total = int(both.lengths[0][found[0]].sum())
                    for side, kind in enumerate(both.kinds):
                        ids_, cuts = found[side].astype(kind), [0, len(found[side])]
                        if total > SPAN:
                            cuts[:1] = np.searchsorted(np.cumsum(both.lengths[side][found[side]]), np.arange(0, total, SPAN), "right").tolist()
                        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                            rows.append((uid, doc_id, k, side, ids_[i:j].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["uid", "doc_id", "span", "side", "ids"])

    return events


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """0 to n - 1 in decimal digits, a row each, at its right end but for one place; and which places of a row are used."""
    shown = np.char.rjust(np.arange(max(1, n)).astype("S"), len(str(max(1, n) - 1)))
    rows = np.pad(shown.view("u1").reshape(len(shown), -1), ((0, 0), (0, 1)))
    return rows, rows != ord(" ")


class Sweep:
    """Takes end events in the order of documents and offsets, and closes a group at each end that both sides have. It holds the
    tokens of the open group, and the numbers and running digest of the open document, whatever their lengths."""

    def __init__(self, kinds: int) -> None:
        self.digits, self.used = _digits(kinds)
        self.lengths, self.ids = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2
        self.owner: tuple | None = None
        self.done: list[tuple] = []
        self._open(None)

    def _open(self, owner: tuple | None) -> None:
        self.owner, self.numbers, self.digest, self.tail = owner, np.zeros(4, np.int64), hashlib.sha256(), b""

    def close(self) -> None:
        """Ends the open document: its row goes to done."""
        if self.owner is not None:
            self.done.append((*self.owner, *self.numbers.tolist(), self.digest.hexdigest() if self.numbers[2] else "", b"", b"", []))
        self._open(None)

    def take(self, owners: list[tuple], sizes: list[list[int]], lengths: list[np.ndarray], ids: list[np.ndarray]) -> None:
        """The next events of both sides: owners are the documents in order, the first of them may be the open one; sizes are
        their numbers of events. What can be closed goes to done, but for the last document's own row."""
        here = owners[:1] == [self.owner]
        if self.owner is not None and not here:
            self.close()
        of = [np.repeat(np.arange(len(owners)), n) for n in sizes]
        of = [np.concatenate([np.zeros(len(x), np.int64), y]) for x, y in zip(self.ids, of, strict=True)]
        lengths = [np.concatenate([x, y]) for x, y in zip(self.lengths, lengths, strict=True)]
        ids = [np.concatenate([x, y]) for x, y in zip(self.ids, ids, strict=True)]
        ends = [np.cumsum(x) for x in lengths]
        at = np.searchsorted(ends[1], ends[0])
        shared = np.flatnonzero(ends[1][np.minimum(at, len(ends[1]) - 1)] == ends[0]) if len(ends[1]) else at[:0]
        last = [shared, at[shared]]  # the last token of each group, of both sides
        n = [int(x[-1]) + 1 if len(x) else 0 for x in last]
        self.lengths, self.ids = [x[k:] for x, k in zip(lengths, n, strict=True)], [x[k:] for x, k in zip(ids, n, strict=True)]
        ids, of, ends = [x[:k] for x, k in zip(ids, n, strict=True)], [x[:k] for x, k in zip(of, n, strict=True)], [x[:k] for x, k in zip(ends, n, strict=True)]
        # Two tokens share bytes before each end of either, and no two of these edges have the same pair.
        edges = np.sort(np.concatenate(ends), kind="stable")
        edges = edges[np.diff(edges, prepend=-1) > 0]
        a, b = (np.searchsorted(e, edges) for e in ends)
        links, owner = ids[0][a] << 32 | ids[1][b], of[0][a]
        groups = of[0][last[0]]
        counts = np.stack([np.bincount(x, minlength=len(owners)) for x in (*of, groups, owner)], axis=1)
        text, stops = self._text(ids, last, of, groups, len(owners))
        cuts = np.append(0, np.cumsum(counts[:, 3]))
        for i, who in enumerate(owners):
            if i or not here:
                self.close()
                self._open(who)
            self.numbers = self.numbers + counts[i]
            if counts[i, 2]:
                self.digest.update(self.tail)
                self.digest.update(text[stops[i] : stops[i + 1] - 1])
                self.tail = bytes(text[stops[i + 1] - 1 : stops[i + 1]])  # no sign follows the last group
                own = np.sort(links[cuts[i] : cuts[i + 1]])
                first = np.flatnonzero(np.diff(own, prepend=-1))
                pairs, times = own[first], np.diff(first, append=len(own))
                row = np.diff(pairs >> 32, prepend=0).astype("<u4").tobytes(), (pairs & 0xFFFFFFFF).astype("<u4").tobytes()
                self.done.append((*who, 0, 0, 0, 0, None, *row, times.astype("i4")))

    def _text(self, ids: list[np.ndarray], last: list[np.ndarray], of: list[np.ndarray], groups: np.ndarray, n: int) -> tuple[memoryview, list[int]]:
        """All groups as text, a sign after each, and where a document's text begins and ends."""
        whole = [np.diff(x, prepend=-1) for x in last]  # tokens of each group
        other = [np.append(0, last[1] + 1)[:-1], last[0] + 1]  # tokens of the other side that come before a group's own
        total = len(ids[0]) + len(ids[1])
        token, sign, place = np.empty(total, np.int64), np.empty(total, "u1"), []
        for side, mark in enumerate(b"|;"):
            place.append(np.arange(len(ids[side])) + np.repeat(other[side], whole[side]))
            token[place[side]] = ids[side]
            sign[place[side]] = ord(",")
            sign[place[side][last[side]]] = mark
        rows, used = self.digits[token], self.used[token]
        rows[:, -1] = sign
        stop = np.cumsum(used.sum(axis=1))
        tokens = np.cumsum(np.bincount(of[0], minlength=n) + np.bincount(of[1], minlength=n))
        return memoryview(rows[used]), [0, *np.append(0, stop)[tokens].tolist()]


_COLUMNS = [("uid", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_LINKS = [*_COLUMNS, ("a", pa.binary()), ("b", pa.binary()), ("n", pa.list_(pa.int32()))]
_DDL = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _swept(a_path: str, b_path: str, most: int = 500_000) -> Callable[[Batches], Batches]:
    """Rows of events, sorted by document, span and side, to rows of links: the different pairs of a document's closed groups with
    their numbers; the last row of a document has its own numbers and digest. About `most` events are swept at once."""

    def sweep(batches: Batches) -> Batches:
        both = _both(a_path, b_path)
        state = Sweep(max(map(len, both.tokens)))
        rows: list[tuple] = []  # of two sides each

        def take() -> None:
            owners, sizes = [], [[], []]
            for owner, two in rows:
                if not owners or owners[-1] != owner:
                    owners.append(owner)
                    for x in sizes:
                        x.append(0)
                for side in (0, 1):
                    sizes[side][-1] += len(two[side]) // np.dtype(both.kinds[side]).itemsize
            ids = [np.frombuffer(b"".join(two[side] for _, two in rows), both.kinds[side]).astype(np.int64) for side in (0, 1)]
            state.take(owners, sizes, [n[x] for n, x in zip(both.lengths, ids, strict=True)], ids)
            rows.clear()

        def made() -> Batches:
            done, state.done = state.done, []
            for i in range(0, len(done), 2_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*done[i : i + 2_000], strict=True), _LINKS, strict=True)], [name for name, _ in _LINKS])

        first, n = None, 0
        for batch in batches:
            for uid, doc_id, side, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                n += len(ids) // 2
                if side == 0:
                    first = ids
                    continue
                rows.append(((uid, doc_id), (first, ids)))
                if n > most:
                    take()
                    yield from made()
                    n = 0
        if rows:
            take()
        state.close()
        yield from made()

    return sweep


def _pairs_of(batch: pa.RecordBatch, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a batch's rows, their numbers, and how many each row has. Rows hold the steps from one A id to the next."""
    sizes = np.array([len(x) // 4 for x in batch.column(at).to_pylist()], np.int64)
    steps, b = (np.frombuffer(b"".join(batch.column(at + k).to_pylist()), "<u4").astype(np.int64) for k in (0, 1))
    a = np.append(0, np.cumsum(steps))
    a = a[1:] - np.repeat(a[np.cumsum(sizes) - sizes], sizes)
    return a << 32 | b, batch.column(at + 2).flatten().to_numpy().astype(np.int64), sizes


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(codes) else n


def _counts(most: int = 2_000_000) -> Callable[[Batches], Batches]:
    """(pair, n): a task's pairs summed up, as far as `most` of them are held."""

    def count(batches: Batches) -> Batches:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

        def rows(codes: np.ndarray, n: np.ndarray) -> Batches:
            for i in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["pair", "n"])

        for batch in batches:
            held.append(_pairs_of(batch)[:2])
            if sum(len(x) for x, _ in held) > most:
                held = [add()]
                if len(held[0][0]) > most // 2:
                    yield from rows(*held[0])
                    held = []
        if held:
            yield from rows(*add())

    return count


def _known(frequent: Broadcast) -> Callable[[Batches], Batches]:
    """Sums over the frequent pairs of each row, and the row's other pairs with their numbers."""

    def look(batches: Batches) -> Batches:
        codes, counts, best = frequent.value
        for batch in batches:
            pair, n, sizes = _pairs_of(batch, 2)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(codes, pair), max(0, len(codes) - 1))
            hit = codes[at] == pair if len(codes) else np.zeros(len(pair), bool)
            found, times = at[hit], n[hit]
            sums = np.zeros(len(sizes), np.int64)
            np.add.at(sums, row[hit], times * counts[found])
            tops = np.zeros(len(sizes), np.int64)
            np.add.at(tops, row[hit], times * best[found])
            rest, where = pair[~hit], np.append(0, np.cumsum(np.bincount(row[~hit], minlength=len(sizes))))
            lists = [pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(x)) for x in (rest, n[~hit])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tops), pa.array(sums), *lists], ["uid", "doc_id", "n_best", "count_sum", "pairs", "times"])

    return look


def groups_and_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Written rows (uid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a, b, n): for each span of a document the ids of
    its different links by rising A id (a: the steps from one to the next, b: the B ids, little-endian unsigned 32-bit) and
    their numbers n, and one row without links for each document with its numbers. uid is a row's own number."""
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    events = own.mapInArrow(_events(a_path, b_path), "uid long, doc_id long, span long, side int, ids binary")
    ordered = events.repartition("uid").sortWithinPartitions("uid", "span", "side")
    return written(ordered.mapInArrow(_swept(a_path, b_path), _DDL + ", a binary, b binary, n array<int>"), "links")


def pair_counts(links: DataFrame) -> DataFrame:
    """Written rows (pair, n, best): how many links a pair of ids has (pair is a << 32 | b), and whether that is the most of
    its B id."""
    spans = links.where("n_links = 0").select("a", "b", "n")
    counts = written(spans.mapInArrow(_counts(), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id")
    most = counts.groupBy(b_id).agg(F.max("n").alias("most"))
    done = written(counts.withColumn("b_id", b_id).join(most, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    discard(counts)
    return done


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, frequent: int = 1_000_000) -> DataFrame:
    """How the tokens of a byte-level tokenizer (A, of a space and the text) and a sentencepiece model (B, of the text) align.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document. Two tokens are linked if
    they share bytes; bytes at which tokens of both end cut them into groups. A pair of ids counts the links that it has in
    all documents; n_best are the links whose pair has the highest count of its B id, count_sum sums the counts.

    The end events of both sides are dealt out by document and sorted by offset, and a sweep that holds no more than the
    open group passes over them. Pairs with at least a `frequent`-th of all links are broadcast: there can be no more than
    that many. All others are joined by shuffle, where none has a larger share.

    Texts that are null or empty, or that either tokenizer changes, have no tokens: zeros, and '' for groups_sha256. Null and
    repeated doc_ids have a row each; very long texts are swept whole; other columns are ignored; no rows give none.
    """
    links = groups_and_links(docs, a_path or vocabulary(), b_path or vocabulary("piece_bpe_32k.model"))
    pairs = pair_counts(links)
    spark = docs.sparkSession
    total = pairs.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= max(1.0, total / frequent)
    top = pairs.where(often).select("pair", "n", F.col("best").cast("long").alias("best")).toArrow().sort_by("pair")
    held = spark.sparkContext.broadcast(tuple(top.column(k).to_numpy() for k in ("pair", "n", "best")))
    spans = links.where("n_links = 0").select("uid", "doc_id", "a", "b", "n")
    summed = written(spans.mapInArrow(_known(held), "uid long, doc_id long, n_best long, count_sum long, pairs array<long>, times array<long>"), "link-sums")
    rare = summed.select("uid", "doc_id", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("uid", "doc_id", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    joined = rare.join(pairs.where(~often), "pair").groupBy("uid", "doc_id").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    own = links.where("groups_sha256 is not null").drop("a", "b", "n").withColumns({"n_best": zero, "count_sum": zero})
    parts = summed.select("uid", "doc_id", "n_best", "count_sum").unionByName(joined)
    parts = parts.withColumns({"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero, "groups_sha256": none}).select(*own.columns)
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    done = own.unionByName(parts).groupBy("uid", "doc_id").agg(*sums, F.max("groups_sha256").alias("groups_sha256"))
    return done.drop("uid")
