import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplet.llm import line_dedup, near_dup, repeats
from ripplet.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi", "ho") for b in ("lan", "mer", "nos", "pit", "rus", "sel", "tav")]


def prose(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(VOCABULARY) + str(rng.randrange(30)) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in texts], SCHEMA)


def copies(seed: int, n: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One TWO"), (5, "É a b c d e"), (6, "é a b c d e")]
    bases = [prose(rng, rng.randrange(20, 200)) for _ in range(6)]
    for i in range(len(out), n):
        words = list(rng.choice(bases)) if rng.random() < 0.8 else prose(rng, 60)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = "x" + str(rng.random())
        out.append((i, " ".join(words)))
    out.append((n, "word " * 30_000))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_has_the_components_of_all_pairs(spark, seed):
    docs = copies(seed, 120)
    rows = near_dup.near_duplicates(table(spark, docs), 5, 85).collect()
    expected, text = brute.near(docs), dict(docs)
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert all(r.n_shingles == len(brute.shingles(text[r.doc_id])) and r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    assert near_dup.near_duplicates(table(spark, [])).collect() == []
    rows = near_dup.near_duplicates(table(spark, [(None, "a b c d e f"), (4, None), (5, " ")])).collect()
    assert {tuple(r) for r in rows} == {(None, 2, None, True), (4, 0, 4, True), (5, 0, 5, True)}
    assert near_dup.near_duplicates(table(spark, [(1, None), (2, "")])).count() == 2


def test_near_copies_go_by_rows_where_ids_are_null_or_repeated(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(prose(rng, 40)) for _ in range(4))
    docs = [(5, a), (5, a), (None, a), (7, b), (3, b + " end"), (7, c), (None, d), (None, d), (None, None), (None, "")]
    left = near_dup.without_copies(table(spark, docs), 5, 80).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted((str(i), str(t)) for i, t in [(5, a), (3, b + " end"), (7, c), (None, d), (None, None), (None, "")])
    rows = near_dup.near_duplicates(table(spark, docs), 5, 80).collect()
    known = sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id is not None)
    assert known == [(3, 3, True), (5, 5, False), (5, 5, True), (7, 3, False), (7, 7, True)]
    assert sorted((r.n_shingles, str(r.component_id), r.kept) for r in rows if r.doc_id is None) == [(0, "None", True), (0, "None", True), (36, "5", False), (36, "None", False), (36, "None", True)]


def test_near_duplicates_in_a_large_mixed_bucket(spark):
    """Copies of one text with edits: many pairs about the threshold, in buckets far over the small ones."""
    rng = random.Random(3)
    base = prose(rng, 120)
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = rng.choice((str(rng.random()), "odd"))
        docs.append((i, " ".join(words)))
    rows = near_dup.near_duplicates(table(spark, docs), 5, 85).collect()
    expected = brute.near(docs)
    assert len(set(expected.values())) > 3 and {r.doc_id: r.component_id for r in rows} == expected


@given(st.text(alphabet="aAbÄ \n\x0b\x85 ", max_size=60))
@settings(max_examples=150, deadline=None)
def test_shingles_are_those_of_the_word_rule(text):
    assert len(near_dup.shingles(text, 5)) == len(brute.shingles(text))


def test_super_minhash_estimates_jaccard():
    import numpy as np

    a = np.arange(1000, dtype=np.uint64)
    both = near_dup.super_minhash([a, a + np.uint64(200), a], 192)
    assert abs((both[0] == both[1]).mean() - 2 / 3) < 0.12
    assert (both[0] == both[2]).all()


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(1000, 1100))}


@pytest.mark.parametrize("seed", [1, 2])
def test_remove_repeats_has_the_bytes_of_brute_force(spark, seed):
    rng = random.Random(seed)
    shared = [" ".join(prose(rng, n)) for n in (5, 12, 40, 150)]
    docs: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "a" * 700), (3, "é" * 300), (4, "ab" * 150)]
    for i in range(5, 40):
        parts = [" ".join(prose(rng, rng.randrange(1, 40))) for _ in range(4)]
        docs.append((i, rng.choice(shared).join(parts)))
    docs += [(50, docs[20][1]), (51, docs[20][1])]
    rows = {r.doc_id: tuple(r[1:5]) for r in repeats.remove_repeats(table(spark, docs), 60).collect()}
    assert rows == {i: x for (i, _), x in zip(docs, brute.kept_bytes([t for _, t in docs], 60), strict=True)}


def test_remove_repeats_at_width_400_with_null_and_repeated_ids(spark):
    rng = random.Random(12)
    shared = [" ".join(prose(rng, n)) for n in (60, 75, 200, 3000)]
    docs: list[tuple[int | None, str | None]] = [(None, None), (None, ""), (7, "ab" * 400), (7, "é" * 700), (None, "x" * 1000)]
    for i in range(24):
        parts = [" ".join(prose(rng, rng.randrange(1, 120))) for _ in range(3)]
        docs.append((rng.choice([None, 5, i]), rng.choice(shared).join(parts)))
    docs += [docs[10], docs[11], (None, docs[12][1])]
    rows = repeats.remove_repeats(table(spark, docs).withColumn("at", F.lit(1)).withColumn("inner", F.lit(2)), 400).collect()
    expected = [(i, *x) for (i, _), x in zip(docs, brute.kept_bytes([t for _, t in docs], 400), strict=True)]
    assert sorted(map(str, (tuple(r[:5]) for r in rows))) == sorted(map(str, expected))


def test_windows_are_named_for_equal_runs_only(spark, monkeypatch):
    rng, kept, tables = random.Random(5), repeats.written, {}
    shared = [bytes(rng.choices(b"abcdefgh", k=90)) for _ in range(6)]
    docs = [(i, (bytes(rng.choices(b"abcdefgh", k=900)) + shared[i % 6] + bytes(rng.choices(b"abcdefgh", k=900))).decode()) for i in range(12)]

    def counted(df, name):
        out = kept(df, name)
        tables[name] = (dict(out.dtypes), out.count(), out.agg(F.sum("n")).head()[0] if "n" in out.columns else None)
        return out

    monkeypatch.setattr(repeats, "written", counted)
    rows = repeats.remove_repeats(table(spark, docs), 60).collect()
    assert all(r.n_removed >= 90 for r in rows)
    assert all(kind != "binary" for kinds, _, _ in tables.values() for kind in kinds.values())
    assert tables["starts"][1] == tables["equal-runs"][2] < tables["runs"][2]


def test_remove_repeats_of_nothing(spark):
    assert repeats.remove_repeats(table(spark, [])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_keeps_the_first_of_each_component(spark, seed):
    rng = random.Random(seed)
    bases = [" ".join(prose(rng, rng.randrange(10, 25))) for _ in range(8)]
    docs: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "\n \n"), (3, "ab\nAB\ncd"), (4, "ab")]
    for i in range(5, 40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(bases) if rng.random() < 0.6 else " ".join(prose(rng, 12))
            at = rng.randrange(len(line))
            lines.append(line[:at] + "q" + line[at + 1 :] if rng.random() < 0.5 else line)
        docs.append((i, "\n".join(lines)))
    rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, docs)).collect()}
    assert rows == {i: t for (i, _), t in zip(docs, brute.line_keep(docs), strict=True)}


def test_line_dedup_links_short_lines_urls_and_lines_about_the_limit_of_signatures(spark):
    rng = random.Random(5)
    stem = "internationalization standardization representations compartmentalized"
    docs: list[tuple[int, str | None]] = [(0, "#internationalization\ninternationalization"), (1, "https://www.example.com/a/very/long/path/page.html\nhttp://www.example.com/a/very/long/path/page.html")]
    docs += [(2, "ha ha ha ha\nha ha ha ha ha ha ha ha"), (3, "abcdefgh\nabcdefghi\nxabcdefgh"), (4, stem + "\n" + stem + " again")]
    for i in range(5, 65):
        words = [rng.choice(VOCABULARY) * rng.randrange(2, 4) + str(rng.randrange(1000)) for _ in range(1 + i % 6)]
        line = rng.choice((" ", "/")).join(words)
        line = ("https://host" + str(i) + ".org/" if i % 4 == 0 else "") + line
        at = rng.randrange(min(8, len(line))) if i % 2 else rng.randrange(len(line))
        docs.append((i, line + "\n" + line[:at] + "#" + line[at + rng.randrange(2) :]))
    rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, docs)).collect()}
    assert rows == {i: t for (i, _), t in zip(docs, brute.line_keep(docs), strict=True)}


def test_line_dedup_compares_few_sets_of_lines_that_are_nearly_alike(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    base = [word() for _ in range(60)]
    docs: list[tuple[int, str | None]] = []
    for i in range(150):  # copies of one line, a sixth of its words replaced, and tables whose cells begin alike
        some = set(rng.sample(range(60), 10))
        docs.append((2 * i, " ".join(word() if k in some else w for k, w in enumerate(base))))
        docs.append((2 * i + 1, " | ".join("th" + word() for _ in range(20))))
    compared, alike = [], line_dedup._alike

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_alike", counted)
    rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, docs)).collect()}
    assert rows == {i: t for (i, _), t in zip(docs, brute.line_keep(docs), strict=True)}
    assert sum(compared) < 200


def test_line_dedup_counts_characters_beyond_16_bits_as_one(spark):
    """Of 41 shingles 5 differ, 36 / 46 < 0.8; half characters would make it 73 / 91."""
    line = "".join(chr(0x1F300 + i) for i in range(45))
    docs: list[tuple[int, str | None]] = [(0, line), (1, line[:22] + "\U0001f600" + line[23:]), (2, line[:-1] + "\U0001f600")]
    rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, docs)).collect()}
    assert rows == {i: t for (i, _), t in zip(docs, brute.line_keep(docs), strict=True)}
    assert rows[1] == docs[1][1] and rows[2] == ""


def test_line_dedup_makes_sets_once_and_below_generators(spark):
    """A generator that makes its array itself isn't compiled; before an inner one Spark filters a column's arrays by their size."""
    texts = spark.createDataFrame([(1, "a line")], "node long, line string").repartition(1)
    plan = line_dedup._marked(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1 and "explode(array_distinct(" not in plan


def test_line_dedup_of_nothing_and_of_clashing_columns(spark):
    empty = line_dedup.dedup_lines(table(spark, []))
    assert empty.collect() == [] and empty.columns[-2:] == ["n_lines", "n_removed"]
    odd = spark.createDataFrame([(1, "a line here\na line here", "x", 5)], "doc_id long, text string, h string, n_lines int")
    row = line_dedup.dedup_lines(odd).first()
    assert (row.text, row.h, row.n_lines, row.n_removed) == ("a line here", "x", 2, 1)


def test_repeats_of_many_equal_rows_take_time_in_proportion(spark):
    """Equal rows are copies of each other; their places are listed once, however many there are."""
    text = " ".join(prose(random.Random(3), 800))
    rows = repeats.remove_repeats(table(spark, [(None, text)] * 2_000 + [(1, "short")]), 400).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    n = len(text.encode())
    assert sorted(tuple(r) for r in rows) == sorted([(n, n, 1, 2_000), (5, 0, 0, 1)])
