"""Benchmark decontamination: exact hits of an item's pieces, verified by Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.encoding import portions

def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    """The edits an item may have; below a rate of 1 each of the errors + 1 pieces has a character."""
    return max(0, min(int(length * rate), length - 1))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces: with no more than so many edits, one of them is untouched."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_end(item: str, text: str) -> tuple[int, int]:
    """(edits, end) of the substring of text nearest to item, the first of the best; Myers 1999."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = ones, 0, m, (m, 0)
    for j, c in enumerate(text, 1):
        x = masks.get(c, 0) | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | ones & ~(d | plus), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best[0]:
            best = (score, j)
        up, down = up << 1 & ones, down << 1 & ones
        plus, minus = down | ones & ~(d | up), up & d
    return best


def _search(items: list[tuple[int, str]], rate: float, columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(automaton, text: str) -> list[tuple[int, int, int]]:
        """(item, edits, end) for each item with its best match in text."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for stop, (length, places) in automaton.iter(text):
            for k, offset in places:
                size = len(items[k][1])
                start, extra = stop + 1 - length - offset, budget(size, rate)
                spans.setdefault(k, []).append((max(0, start - extra), min(len(text), start + size + extra)))
        out = []
        for k, near in spans.items():
            item = items[k][1]
            best = None
            at = 0
            near.sort()
            while at < len(near):
                a, b = near[at]
                while at < len(near) and near[at][0] <= b:
                    b = max(b, near[at][1])
                    at += 1
                exact = text.find(item, a, b)
                edits, end = (0, exact + len(item) - a) if exact >= 0 else best_end(item, text[a:b])
                if edits <= budget(len(item), rate) and (best is None or edits < best[0]):
                    best = (edits, a + end)
                    if not edits:
                        break
            if best:
                out.append((k, *best))
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(items):
            for offset, piece in pieces(item, budget(len(item), rate)):
                places.setdefault(piece, []).append((k, offset))
        automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            automaton.add_word(piece, (len(piece), at))
        automaton.make_automaton()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in portions(texts):
                rows = [(doc, items[k][0], edits, end) for doc, text in zip(ids[part], texts[part], strict=True) for k, edits, end in found(automaton, plain(text))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "item_id", "edits", "end"])

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """Pairs of a document and a benchmark item that the document holds up to rate * length edits of characters.

    Returns doc_id, item_id, edits (the least), end (of that match, in characters of the text with A-Z and other capitals
    in lower case and white space as single spaces), one row a pair. Items are sent to the tasks in blocks of at most
    `block_chars` characters (a longer item is a block by itself); each block reads all documents. Items without a word
    or with a null id are left out, as are null texts and documents with a null doc_id; repeated rows give repeated
    pairs once. Other columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "doc_id long, item_id long, edits long, end long")
    block: list[tuple[int, str]] = []
    size = 0

    def go(out: DataFrame) -> DataFrame:
        return out.unionByName(rows.mapInArrow(_search(block, rate, 2), "doc_id long, item_id long, edits long, end long"))

    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        item = plain(r["text"])
        if item:
            if block and size + len(item) > block_chars:
                out, block, size = go(out), [], 0
            block.append((r["item_id"], item))
            size += len(item)
    if block:
        out = go(out)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "end")).alias("m")).select("doc_id", "item_id", "m.edits", "m.end")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05) -> DataFrame:
    """The documents without any match, with all their columns. Null texts stay. A row goes by its own text (its 64-bit
    hash), whether its doc_id is null, repeated or neither."""
    key = F.xxhash64("text")
    bad = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, rate).select(F.col("doc_id").alias("__key")).distinct()
    return docs.withColumn("__key", key).join(bad, "__key", "left_anti").select(*docs.columns)
