"""Every operator on null and repeated ids, null, empty and very long texts, repeated rows, clashing columns, empty tables."""

import pytest

from ripplet.llm import decontaminate, kd_shards, line_crf, line_dedup, near_dup, packing, repeats, site_quality, token_files

LONG = "word of a long text, " * 15_000
ROWS = [(None, "a few words here\nand there"), (None, "other words"), (4, "a few words here\nand there"), (4, "a few words here\nand there"), (5, None), (6, ""), (7, LONG)]
SCHEMA = "doc_id long, text string, source string, lang string, key string, at int, shard int, label int, n_chars long"


def odd(spark, rows):
    return spark.createDataFrame([(*r, "h/p", None, "k", 1, 2, 3, 4) for r in rows], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(4, 1), (5, 0), (None, 1), (7, 0), (4, 1)], "doc_id long, quality int")


def benchmark(spark, rows=((1, "a few words here and there"), (None, "other words"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


ONE_ROW_EACH = {
    "op1": lambda spark, d: repeats.remove_repeats(d, 400),
    "op2": lambda spark, d: site_quality.site_quality(d, labels(spark)),
    "op3": lambda spark, d: line_crf.quality_rules(d, labels(spark)),
    "op4": lambda spark, d: kd_shards.shards(d, 24),
    "op5": lambda spark, d: token_files.token_files(d),
    "op7": lambda spark, d: near_dup.near_duplicates(d),
    "op9": lambda spark, d: line_dedup.dedup_lines(d),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_each_row_has_its_own_in_the_result(spark, name):
    found = ONE_ROW_EACH[name](spark, odd(spark, ROWS)).select("doc_id").collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(i) for i, _ in ROWS)


def test_packing_of_odd_rows(spark):
    rows = packing.pack(odd(spark, ROWS), 1024).collect()
    starts = [r for r in rows if r.start == 0]
    assert sorted(str(r.doc_id) for r in starts) == sorted(str(i) for i, _ in ROWS)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and max(r.length for r in rows) <= 1024


def test_decontamination_of_odd_rows_and_empty_sides(spark):
    docs = odd(spark, ROWS)
    pairs = decontaminate.contaminated(docs, benchmark(spark))
    assert [(r.doc_id, r.item_id, r.edits) for r in pairs.collect()] == [(4, 1, 0)]
    left = decontaminate.decontaminate(docs, benchmark(spark)).collect()
    assert sorted(str(r.doc_id) for r in left) == ["5", "6", "7", "None"] and left[0].key == "k"
    assert decontaminate.contaminated(docs, benchmark(spark, ())).collect() == []
    assert decontaminate.contaminated(odd(spark, []), benchmark(spark)).collect() == []


def test_shards_of_ties_and_repeated_rows_are_gapless(spark):
    rows = kd_shards.shards(odd(spark, [(None, "x")] * 40 + [(3, "y")] * 60), 24).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 100 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_token_files_of_null_and_repeated_ids_are_in_order(spark):
    rows = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in token_files.token_files(odd(spark, ROWS)).collect())
    assert [r[2] for r in rows] == [-1, -1, 4, 4, 5, 6, 7]
    assert [r[0] for r in rows] == [sum(x[1] for x in rows[:i]) for i in range(len(rows))]
