"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.llm.common import discard, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table of sources that may be broadcast; a larger one is joined by shuffle, where AQE splits hot sources.
MOST_SOURCES = 100_000
#: Rows that one block of a queue holds on average.
BLOCK = 250
ROW = ["doc_id", "source", "size", "digest", "copy"]


def before(blocks: DataFrame, groups: list[str], at: str, value: str, name: str) -> DataFrame:
    """Adds name, the sum of value over the blocks of a group that come before a block (numbered by at). Windows go over
    BLOCK blocks and over their sums, so that the largest holds the square root of a group's rows or so."""
    wide = blocks.withColumn("__wide", F.floor(F.col(at) / BLOCK))
    sums = wide.groupBy(*groups, "__wide").agg(F.sum(value).alias("__sum"))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = sums.withColumn("__first", F.coalesce(F.sum("__sum").over(earlier(groups, "__wide")), F.lit(0))).drop("__sum")
    inside = wide.withColumn("__inside", F.coalesce(F.sum(value).over(earlier([*groups, "__wide"], at)), F.lit(0)))
    return inside.join(first, [*groups, "__wide"]).withColumn(name, F.col("__first") + F.col("__inside")).drop("__wide", "__first", "__inside")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds rank to rows (source, ...) with unique sources: 0, 1, 2, ... by code point, null last. Sources are range-sorted
    into partitions once; only the partitions' counts, one number each, meet."""
    order = F.asc_nulls_last("source")
    parted = written(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = before(parted.groupBy("part").count().withColumn("__all", F.lit(0)), ["__all"], "part", "count", "first").select("part", "first")
    here = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parted.withColumn("here", here).join(counts, "part").withColumn("rank", F.col("first") + F.col("here") - 1).drop("part", "here", "first")


def targets(sources: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """Adds weight and target to written rows (source, rank, source_size). The budget, share times all sizes, is dealt by
    weight; what a source can't give in so many epochs is dealt again among the others until no target is above that.
    Each round is one sum over the sources; a round fixes at least one more source, and few rounds are needed."""
    most = (F.col("source_size") * epochs).cast("double")
    held = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    all_sizes, all_weights = held.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, fixed, full = share * (all_sizes or 0), 0.0, -1, F.lit(False)
    given, rest = 0.0, float(all_weights or 0)
    while rest:
        level = (budget - given) / rest
        full = most <= F.col("weight") * F.lit(level)
        n, given, open_weights = held.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        if n == fixed:
            break
        fixed, rest = n, float(open_weights)
    dealt = F.lit(budget - given) * F.col("weight") / F.lit(rest or 1.0)
    return held.withColumn("target", F.when(full, most).otherwise(dealt))


def _joined(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    small = sources.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(small) if n <= MOST_SOURCES else small, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _place(key: Column, blocks: Column) -> Column:
    """The block, 0 to blocks - 1, of a hexadecimal key: an even part of the keys' range."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2.0**32 * blocks)


def queue(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The mix as a queue: doc_id, source, size, digest and copy of a document, source_size and target of its source, epoch,
    finish (its virtual finish time), start (words of the mix before it), taken (whether the budget still covers it).

    Every epoch of a source is its documents shuffled by the MD5 of seed, doc_id, text and epoch. A document's virtual
    finish time is the words of its source up to its end, divided by the source's target. The queue is sorted by
    it over all sources, and cut where the words exceed the budget, share times all words. At finish time 1 each source has
    given its target but for a part of one document, and so has the whole queue given its budget.

    Null and wordless texts have no words and aren't in the queue. Null doc_ids and sources are values like others. Rows that
    are equal in doc_id, source and text are told apart by copy, 0, 1, 2, ... Very long texts are taken whole or not at all.
    Other columns are ignored. No rows, or none with words: an empty queue.
    """
    rows, sources, n = _rows(docs, weights, share, epochs)
    return _queue(rows, sources, n, share, epochs, seed)[0]


def _rows(docs: DataFrame, weights: Sequence[int], share: float, epochs: int) -> tuple[DataFrame, DataFrame, int]:
    """The written rows of all documents, and of all sources with their targets; the number of sources."""
    if not 0 <= share <= epochs:
        raise ValueError("the share must be between 0 and the number of epochs")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    plain = docs.select("doc_id", "source", size.alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    equal = plain.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n"))
    rows = written(equal.select("doc_id", "source", "size", "digest", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    named = written(ranked(sizes), "mix-ranks")
    sources = targets(named, weights, share, epochs)
    return rows, sources.drop("weight"), named.count()


def _queue(rows: DataFrame, sources: DataFrame, n: int, share: float, epochs: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The queue, and the written table that it reads."""
    total = rows.agg(F.sum("size"), F.count("*")).first()
    budget, blocks = share * (total[0] or 0), max(1, math.ceil(total[1] * epochs / BLOCK))
    named = _joined(rows.where("size > 0"), sources, n).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    # An epoch begins at source_size * epoch: none is needed from the target on, but for the one that stands across it.
    open_ = named.where(F.col("source_size") * F.col("epoch") <= F.col("target"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("copy").cast("string"), F.col("epoch").cast("string")))
    dealt = open_.withColumn("key", key).withColumn("block", _place(F.col("key"), F.ceil(F.col("source_rows") / BLOCK)))
    firsts = before(dealt.groupBy("rank", "epoch", "block").agg(F.sum("size").alias("words")), ["rank", "epoch"], "block", "words", "first").drop("words")
    inside = F.sum("size").over(Window.partitionBy("rank", "epoch", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    ended = dealt.withColumn("inside", inside).join(firsts, ["rank", "epoch", "block"])
    finish = (F.col("source_size") * F.col("epoch") + F.col("first") + F.col("inside")).cast("double") / F.col("target")
    timed = written(ended.withColumn("finish", finish).drop("inside", "first", "block", "source_rows"), "mix-times")
    # Equal spans of virtual time hold about as many words, whatever the sources.
    spans = timed.withColumn("span", F.floor(F.col("finish") * blocks))
    starts = before(spans.groupBy("span").agg(F.sum("size").alias("words")).withColumn("__all", F.lit(0)), ["__all"], "span", "words", "first").select("span", "first")
    order = Window.partitionBy("span").orderBy("finish", "rank", "epoch", "key").rowsBetween(Window.unboundedPreceding, 0)
    ends = spans.withColumn("inside", F.sum("size").over(order)).join(starts, "span").withColumn("end", F.col("first") + F.col("inside"))
    kept = [*ROW, "source_size", "target", "epoch", "finish"]
    return ends.select(*kept, (F.col("end") - F.col("size")).alias("start"), (F.col("end") <= F.lit(budget)).alias("taken")), timed


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """What the mix holds: the documents of queue() that its budget covers, with their place (start) in it."""
    return queue(docs, weights, share, epochs, seed).where("taken").drop("taken")


def taken_words(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """A row for each document: doc_id, size, source_size, target (its source's), taken (the words that the mix takes of it,
    repeats counted). Odd rows as in queue(); documents without words have 0 taken; no rows give none."""
    rows, sources, n = _rows(docs, weights, share, epochs)
    places, timed = _queue(rows, sources, n, share, epochs, seed)
    queued = places.select(*ROW, "source_size", "target", F.when(F.col("taken"), F.col("size")).otherwise(0).alias("words"))
    least = _joined(rows, sources, n).select(*ROW, "source_size", "target", F.lit(0).cast("long").alias("words"))
    both = written(queued.unionByName(least).groupBy(*ROW, "source_size", "target").agg(F.sum("words").alias("taken")), "mix-taken")
    discard(rows, timed, sources)
    return both.select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB SQL, for the parameters of the registered query.
SQL = """
with plain as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, md5(coalesce(text, '')) as digest
    from documents
), numbered as (
    select *, row_number() over (partition by doc_id, source, size, digest) - 1 as copy from plain
), sizes as (
    select source, sum(size)::bigint as source_size from plain group by source
), ranked as (
    select *, 2.0::double * source_size as most, [5, 2, 1][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as weight,
        row_number() over (order by source nulls last) - 1 as rank
    from sizes
), budget as (
    select 1.5::double * sum(source_size) as words from sizes
), steps as (
    select *, sum(most) over filled - most as given, (select sum(weight) from ranked) - sum(weight) over filled + weight as rest
    from ranked window filled as (order by most / weight, rank rows unbounded preceding)
), full_ as (
    select steps.*, most * rest <= weight * (words - given) as is_full from steps, budget
), closed as (
    select coalesce(sum(most) filter (where is_full), 0)::double as given, coalesce(sum(weight) filter (where not is_full), 0)::double as rest from full_
), targets as (
    select source, rank, source_size,
        case when is_full then most else (words - closed.given) * weight / case when closed.rest = 0 then 1 else closed.rest end end as target
    from full_, closed, budget
), items as (
    select n.*, t.rank, t.source_size, t.target, e.epoch,
        md5('mix:' || coalesce(doc_id::varchar, '') || ':' || digest || ':' || copy || ':' || e.epoch) as key
    from numbered n join targets t on n.source is not distinct from t.source, (values (0), (1)) e(epoch)
    where size > 0 and source_size * e.epoch <= target
), timed as (
    select *, (source_size * epoch + sum(size) over (partition by rank, epoch order by key))::double / target as finish from items
), queued as (
    select *, sum(size) over (order by finish, rank, epoch, key) as ends from timed
), mixed as (
    select doc_id, source, digest, copy, sum(size) as taken from queued, budget where ends <= words group by all
)
select n.doc_id, n.size, t.source_size, t.target, coalesce(m.taken, 0)::bigint as taken
from numbered n join targets t on n.source is not distinct from t.source
left join mixed m on m.doc_id is not distinct from n.doc_id and m.source is not distinct from n.source and m.digest = n.digest and m.copy = n.copy
"""
