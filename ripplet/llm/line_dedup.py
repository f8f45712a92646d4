"""Fuzzy line deduplication with DataFrame functions only: bottom-k MinHash signatures of character shingles, banding,
exact Jaccard verification, and union-find that keeps one line of each component."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.llm.candidates import across, star
from ripplet.llm.common import discard, written
from ripplet.llm.components import components

#: A line takes part if it has a word.
WORD = r"[^\x20\x09-\x0D]"
#: The bytes of 5 characters, and of one, in UTF-32: the shingles of verification are every 5 characters.
SHINGLE, CHARACTER = 20, 4
#: A line signs what begins at its words if it has so many of them, each of so many characters on average at most; with
#: fewer or longer ones it signs every 5 characters. Between the limits it does both, so that like lines meet.
WORDS, MOST_WORDS, LONG, LONGEST = 14, 20, 14, 24
#: Sets of fewer shingles than the second number are found without loss, those of the first and more by bands.
SMALL, MOST_SMALL = 16, 24
#: A word of fewer characters (a table's bars, articles) says little: its shingle holds all of the next word.
SHORT = 3
#: A set's marks are so many words of 64 bits, each bit the parity of the shingles whose hash falls on it.
MARKS = 16


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))


def _lines(docs: DataFrame) -> DataFrame:
    """(id, h, no, line, k1, k2) of each line with a word; k1 and k2 are two hashes of the line."""
    # The text's hash is taken below the generator: beside it, it would be taken once for every line.
    hashed = docs.select(_id().alias("id"), F.xxhash64("text").alias("h"), "text")
    rows = hashed.select("id", "h", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.col("line").rlike(WORD))
    return rows.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(7), "line")})


def _grams(line: str, hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """The hashes of all shingles of a column, repeats included; a line shorter than 5 characters is one shingle.

    In UTF-32 a shingle is a piece of bytes whose place is known, so it is cut out without a walk over the text.
    """
    at = lambda b: F.sequence(F.lit(1), F.greatest(F.octet_length(b) - SHINGLE + 1, F.lit(1)), F.lit(CHARACTER))
    # The outer array of one holds the bytes, so that they aren't made again for each shingle.
    bytes_of = F.array(F.encode(F.lower(line), "utf-32"))
    return F.transform(bytes_of, lambda b: F.transform(at(b), lambda i: hashed(F.substr(b, i, F.lit(SHINGLE)))))[0]


def _signed(rows: DataFrame, percent: int, smallest: int) -> DataFrame:
    """Adds sketches: for each kind of shingle that the line signs (kind, least), least hashes in their order.

    Kind 1 are shingles of words, each with the two characters at the start of the next word (a SHORT word with the whole
    next one); the others are every 5 characters: of kind 0 a fixed number, of kind 2 (small sets) as many as may be missing from a set that is alike and one
    more, so that two such sets have one in common.
    """
    # What is used more than once stands in a select of its own, whose expressions are compiled; below a generator, which takes
    # its arrays uncompiled, they cost twice as much.
    parts = rows.withColumn("words", F.split(F.lower("line"), " "))
    n, size = F.size("words"), F.length("line")
    ahead = lambda w, x: F.when(F.length(w) < SHORT, x).otherwise(F.substring(x, 1, 2))
    at_words = F.zip_with("words", F.slice("words", F.lit(2), n), lambda w, x: F.hash(w, ahead(w, x)))
    is_every, is_words = (n < MOST_WORDS) | (size > LONG * n), (n >= WORDS) & (size <= LONGEST * n)
    grams = F.when(is_every, F.sort_array(F.array_distinct(_grams("line", F.hash))))
    words = F.when(is_words, F.slice(F.sort_array(F.array_distinct(at_words)), 1, smallest))
    made = parts.select(*rows.columns, grams.alias("grams"), words.alias("least"))
    grams, n = F.col("grams"), F.size("grams")
    sketch = lambda kind, when, c: F.when(when, F.struct(F.lit(kind).alias("kind"), c.alias("least")))
    few = (n - F.ceil(n * percent / 100) + 1).cast("int")
    kinds = (
        sketch(0, n >= SMALL, F.slice(grams, 1, smallest * 3 // 2)),
        sketch(1, F.col("least").isNotNull(), F.col("least")),
        sketch(2, (n > 0) & (n < MOST_SMALL), F.slice(grams, F.lit(1), F.greatest(few, F.lit(1)))),
    )
    return made.withColumn("sketches", F.array_compact(F.array(*kinds))).drop("grams", "least")


def _banded(signed: DataFrame, rows: int) -> DataFrame:
    """(node, bucket): `rows` hashes that follow each other in a sketch make a band; a shorter sketch is one, and so is
    each hash of kind 2."""
    sketches = signed.select(F.col("k1").alias("node"), F.explode("sketches").alias("s")).select("node", "s.kind", "s.least")
    runs = F.arrays_zip(*[F.slice("least", F.lit(i + 1), F.size("least")).alias(str(i)) for i in range(rows)])
    each = sketches.select("node", "kind", F.posexplode(runs).alias("at", "r"))
    each = each.where(F.col(f"r.{rows - 1}").isNotNull() | (F.col("at") == 0) | (F.col("kind") == 2))
    run = [F.col("r.0"), *[F.when(F.col("kind") != 2, F.col(f"r.{i}")) for i in range(1, rows)]]
    return each.select("node", F.xxhash64("kind", *run).alias("bucket"))


def _shared(signed: DataFrame, rows: int) -> DataFrame:
    """(bucket, node, least) of the buckets of several nodes; least is a bucket's least node. Bands are dealt out once, and
    a line that comes often is banded once for each task that read it."""
    nodes = signed.select("k1", "sketches").groupBy("k1").agg(F.first("sketches").alias("sketches"))
    bucket = Window.partitionBy("bucket")
    ends = {"least": F.min("node").over(bucket), "most": F.max("node").over(bucket)}
    found = _banded(nodes, rows).withColumns(ends).where("least < most").select("bucket", "node", "least")
    return written(found.distinct(), "line-members")


def _marked(texts: DataFrame) -> DataFrame:
    """(node, n, m0, m1, ...): the size of each line's set and its marks."""
    # The set is made below the generator, which is compiled then. It is an outer one: before others Spark filters a column's
    # arrays by their size, and makes them for that too. No set is empty.
    sets = texts.select("node", F.array_distinct(_grams("line")).alias("s"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("g", 4).bitwiseAND(63).cast("int"))
    each = sets.select("node", F.explode_outer("s").alias("g")).select("node", F.col("g").bitwiseAND(MARKS - 1).alias("w"), bit.alias("bit"))
    words = [F.bit_xor(F.when(F.col("w") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(MARKS)]
    return each.groupBy("node").agg(F.count("*").alias("n"), *words)


def _near(x: str, y: str, percent: int) -> Column:
    """Whether two sets can be alike, without loss: of sizes m and n they differ in (m + n) (100 - percent) / (100 + percent)
    shingles at most, and each mark that differs takes one."""
    differ = sum((F.bit_count(F.col(f"m{i}{x}").bitwiseXOR(F.col(f"m{i}{y}"))) for i in range(1, MARKS)), F.bit_count(F.col(f"m0{x}").bitwiseXOR(F.col(f"m0{y}"))))
    m, n = F.col("n" + x), F.col("n" + y)
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & ((100 + percent) * differ <= (100 - percent) * (m + n))


def _alike(pairs: DataFrame, texts: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose lines are alike, by whole sets; n is the sum of the sizes of a pair's sets."""
    a, b = (texts.select(F.col("node").alias(e[1]), F.col("line").alias("line" + e)) for e in ("_a", "_b"))
    both = pairs.join(a, "a").join(b, "b")
    # shared / (n - shared) >= percent / 100; each set stands here once, so that it is made once.
    fits = F.size(F.array_intersect(_grams("line_a"), _grams("line_b"))) * (100 + percent) >= percent * F.col("n")
    return written(both.where(fits).select("a", "b"), name)


def line_components(docs: DataFrame, percent: int = 80, smallest: int = 14, rows: int = 3) -> DataFrame:
    """(node, component) of the lines (by k1) in a component of several."""
    members = _shared(_signed(_lines(docs), percent, smallest), rows)
    nodes = members.select("node").distinct()
    lines = _lines(docs).select(F.col("k1").alias("node"), "line").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    texts = written(lines, "line-texts")
    marks = written(_marked(texts), "line-marks")
    a, b = (marks.select(F.col("node").alias(e[1]), *[F.col(c).alias(c + e) for c in marks.columns[1:]]) for e in ("_a", "_b"))
    pairs = written(star(members).join(a, "a").join(b, "b").where(_near("_a", "_b", percent)).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n")), "line-pairs")
    near = _alike(pairs, texts, percent, "line-links")
    found = components(near, "line-components")
    more = across(members, found, "line", lambda mixed: mixed.join(marks, "node"), lambda x, y: _near(x, y, percent), ("n",))
    if more.limit(1).count():
        found = components(near.union(_alike(more, texts, percent, "line-links")), "line-components")
    discard(members, texts, marks, pairs, more)
    return found


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Documents without the lines that came before: of each component of lines, only the first stays, in the order of
    doc_id and line number. All columns are kept; text loses its removed lines, and n_lines (lines with a word) and
    n_removed are added.

    Lines are linked if the Jaccard similarity of their sets of 5 lower-case characters is at least percent / 100 (lines
    shorter than that: if they are equal but for case); lines without a word stay and link nothing. Null texts stay null,
    a text whose lines all came before becomes empty. Null doc_ids come last; rows that repeat doc_id and text are one
    document and lose the same lines. Very long lines are compared whole. An empty table gives no rows; a column of docs
    that is named n_lines or n_removed is replaced.

    Equal lines are told by two 64-bit hashes; a pair of lines that are alike is found if they share `rows` least hashes
    that follow each other, which about 99 % of pairs at the threshold do; pairs of fewer than 16 shingles are all found.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    found = line_components(docs, percent)
    place = F.struct("id", "h", "no")
    grouped = _lines(docs).select("id", "h", "no", "k1", "k2").join(found.toDF("k1", "component"), "k1", "left")
    # A line in no component stands for itself, by both of its hashes.
    group = {"g1": F.coalesce("component", "k1"), "g2": F.when(F.col("component").isNull(), F.col("k2")).otherwise(0)}
    grouped = written(grouped.withColumns(group).select("id", "h", "no", "g1", "g2"), "line-groups")
    first = grouped.groupBy("g1", "g2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = grouped.join(first.select("g1", "g2", "first"), ["g1", "g2"]).where(place != F.col("first"))
    gone = gone.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set("no").alias("__gone"))
    parts = F.split("text", "\n")
    rest = F.filter(parts, lambda x, i: ~F.array_contains(F.col("__gone"), i))
    joined = docs.select(*columns, _id().alias("__id"), F.xxhash64("text").alias("__h")).join(gone, ["__id", "__h"], "left")
    counted = F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(WORD))), F.lit(0))
    lost = F.col("__gone").isNotNull()
    done = joined.withColumns(
        {
            "__n": F.when(F.col("text").isNull(), 0).otherwise(counted),
            "__r": F.when(lost, F.size("__gone")).otherwise(0),
            "__t": F.when(lost, F.array_join(rest, "\n")).otherwise(F.col("text")),
        }
    )
    text = [F.col("__t").alias("text") if c == "text" else F.col(c) for c in columns]
    return done.select(*text, F.col("__n").cast("long").alias("n_lines"), F.col("__r").cast("long").alias("n_removed"))
