"""Spelling variants: words that one edit parts, their forms and roots."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import discard, written
from ripplet.llm.encoding import portions
from ripplet.llm.wavelets import near

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {x: x + 32 for x in range(65, 91)}
Batches = Iterator[pa.RecordBatch]


def runs_of(doc_id: int | None, text: str | None, marked: int, least: int) -> Counter[str]:
    """The words of one text with their number: lower-cased runs of letters; one code point goes where `marked` divides the
    CRC-32 of <doc_id>:<run>."""
    head, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in Counter(RUN.findall(text or "")).items():
        if len(run) >= least:
            word = run.lower() if run.isascii() else run.translate(LOWER)
            h = zlib.crc32(word.encode(), head)
            if not h % marked:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= least:
                out[word] += n
    return out


def _counted(marked: int, least: int, most: int = 200_000) -> Callable[[Batches], Batches]:
    def count(batches: Batches) -> Batches:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter[str] = Counter()
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for part in portions(texts):
                for i, text in zip(ids[part], texts[part], strict=True):
                    for word, n in runs_of(i, text, marked, least).items():
                        held[word] += n
                if len(held) > most:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return count


def word_counts(docs: DataFrame, marked: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of all words of whole texts. Each task sums up what it reads, and its sums are added by word."""
    some = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counted(marked, least_length), "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _contexts(words: DataFrame) -> DataFrame:
    """(length, pieces, piece, head, tail, middle, short, n, word): each word with the context of half an edit position.

    A pair with an edit has a shorter word of `length` code points (or both have it). Of it, the half with the edit is the
    middle; the code points before it (head) and after it (tail) are the same in both words. A word can be the shorter or the
    longer one of a pair, and the edit can be in either half: four rows.
    """
    long = F.length("word")
    lengths = F.filter(F.array(long, long - 1), lambda x: x > 0)
    each = words.select("word", "n", F.explode(lengths).alias("length")).withColumn("piece", F.explode(F.array(F.lit(0), F.lit(1))))
    return _middles(each.withColumn("pieces", F.lit(2)))


def _edge(j: Column) -> Column:
    return F.floor(j * F.col("length") / F.col("pieces")).cast("int")


def _middles(each: DataFrame) -> DataFrame:
    """Adds head, tail, middle and short to rows (word, n, length, pieces, piece): the piece's code points are the middle."""
    start, end, long = _edge(F.col("piece")), _edge(F.col("piece") + 1), F.length("word")
    rest = F.col("length") - end
    parts = {"head": F.substring(F.col("word"), F.lit(1), start), "tail": F.right(F.col("word"), rest), "middle": F.substring(F.col("word"), start + 1, long - start - rest)}
    return each.withColumns(parts).withColumn("short", long == F.col("length"))


KEY = ["length", "pieces", "piece", "head", "tail"]


def _grouped(contexts: DataFrame, most: int, name: str) -> DataFrame:
    """The contexts in groups whose middles have `most` code points in all, or so: a larger group is parted by giving its words
    half the middle and so more context, again and again. A middle of one code point ends that: such a group has a word for
    each letter, or for two. Nothing is left out, as an edit in a piece is in one of its halves."""
    done, now = None, written(contexts, name)
    while True:
        weight = F.sum(F.length("middle") + 1)
        large = now.groupBy(*KEY).agg(weight.alias("w")).where((F.col("w") > most) & (F.col("length") > F.col("pieces"))).drop("w")
        large = written(large, f"{name}-large")
        if not large.limit(1).count():
            return now if done is None else done.unionByName(now)
        small = now.join(large, KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        again = now.join(large, KEY, "left_semi").select("word", "n", "length", (F.col("pieces") * 2).alias("pieces"), F.explode(F.array(F.col("piece") * 2, F.col("piece") * 2 + 1)).alias("piece"))
        now = written(_middles(again), name)


def _pairs(cells: int) -> Callable[[Batches], Batches]:
    """(word, near, near_n) of rows that come sorted by group: whole groups are gathered until their middles fill so many
    cells, and are then indexed and searched together."""

    def found(group: list[int], middles: list[str], short: list[bool], words: list[str], n: list[int]) -> Batches:
        seen = [np.zeros(0, np.int64)]
        for a, b in near(np.array(group), middles, np.array(short, bool)):
            seen.append(a << 32 | b)
            seen.append(b << 32 | a)
        code = np.unique(np.concatenate(seen))
        for at in range(0, len(code), 50_000):
            a, b = (code[at : at + 50_000] >> 32).tolist(), (code[at : at + 50_000] & 0xFFFFFFFF).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in a], pa.string()), pa.array([words[i] for i in b], pa.string()), pa.array([n[i] for i in b], pa.int64())], ["word", "near", "near_n"])

    def search(batches: Batches) -> Batches:
        held: tuple[list, ...] = ([], [], [], [], [])
        last, number, start, width = None, 0, 0, 1  # start: where the last group begins
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, middle, short, word, n in zip(*columns, strict=True):
                if key != last:
                    if len(held[0]) - start == 1:  # a group of one word
                        for x in held:
                            x.pop()
                    if len(held[0]) * width > cells:
                        yield from found(*held)
                        held, width = ([], [], [], [], []), 1
                    last, number, start = key, number + 1, len(held[0])
                width = max(width, len(middle) + 1)
                for x, value in zip(held, (number, middle, short, word, n), strict=True):
                    x.append(value)
        if len(held[0]) - start > 1 or start:
            yield from found(*held)

    return search


def near_words(words: DataFrame, most: int = 50_000, cells: int = 400_000) -> DataFrame:
    """(word, near, near_n), one row for each word of (word, n), a written table, and each word that one edit parts from it."""
    rows = _grouped(_contexts(words), most, "spelling")
    order = [*KEY, "word"]
    sorted_ = rows.select(*KEY, "middle", "short", "word", "n").repartition(*KEY).sortWithinPartitions(*order)
    pairs = sorted_.mapInArrow(_pairs(cells), "word string, near string, near_n long")
    # A pair whose edit can stand at the edge of two pieces is found in both.
    return pairs.repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): each round joins a word's last known form with that one's, so ways double."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        more = now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, now = now, written(more, "roots")
        discard(before)
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, marked: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """Words of whole texts with their forms: word, n, n_near, form, form_n, root.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, of least_length code points and
    least_count occurrences; a code point goes from a run where `marked` divides the CRC-32 of its document's id and the run.
    Words are near if they differ by one inserted, deleted or replaced code point. A word's form is the near word that occurs
    most often (the least in code-point order among equals) if that is `ratio` times as often as the word; its root is where
    forms lead. Numbers grow from form to form, so this ends.

    Null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each; texts and words of any
    length are taken whole; other columns are ignored; no rows give none.
    """
    if ratio < 2:
        raise ValueError("forms may lead in a circle")
    words = written(word_counts(docs, marked, least_length, least_count), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form = F.when(-F.col("best.less") >= F.col("n") * ratio, F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    named = written(words.join(best, "word", "left").withColumn("f", form).select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "f.form", "f.form_n"), "forms")
    roots = _roots(named.where("form is not null"))
    done = named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    discard(words)
    return done
