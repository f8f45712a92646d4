"""Operators 11 to 13 against plain versions, and on odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplet.llm import alignment, mixing, queries, spelling
from ripplet.llm.encoding import encoder, vocabulary
from ripplet.llm.pieces import PieceEncoder
from ripplet.llm.wavelets import WaveletTree, near
from tests.compare import duck, of_spark, of_sql

SF = "/root/testdata/sf0.001"
PIECES = vocabulary("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, rank int, block int, key string, n long, word string, uid long"
ODD = [(None, "Über Wörter, words words", "b"), (None, None, None), (4, "words again <|endoftext|> <s>", "a"), (4, "words again <|endoftext|> <s>", "a"), (5, "", "b"), (6, " \n\t", None), (7, "word of a long text, \n" * 9_000, "a")]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, 1, 2, "k", 3, "w", 4) for r in rows], SCHEMA)


# Spelling variants


def one_edit(a: str, b: str) -> bool:
    """By the definition: b is a with one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(docs):
    """Every word against every other."""
    n = Counter()
    for i, text in docs:
        n.update(spelling.runs_of(i, text, 97, 5))
    n = {w: k for w, k in n.items() if k >= 3}
    close = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(close[w]), n.get(form.get(w))))
    return sorted(out)


def misspelt(seed):
    rng = random.Random(seed)
    letters = "abcàéÿ"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(12)]
    words = []
    for _ in range(2_500):
        w = list(rng.choice(bases[: rng.randrange(1, 13)]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        words.append("".join(w))
    return [(i, " ".join(words[i::20]) + "X") for i in range(20)]


@pytest.mark.parametrize("most", [50_000, 30])
def test_variants_are_those_of_all_pairs(spark, most, monkeypatch):
    docs = misspelt(3)
    whole = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda words: whole(words, most, 400))
    rows = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).select("word", "form", "root", "n", "n_near", "form_n").collect()
    expected = variants(docs)
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert sum(r[1] is not None for r in expected) > 50 and any(r[1] != r[2] for r in expected if r[1])


def test_the_query_of_variants_is_that_of_all_pairs_on_a_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op11_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(variants(docs), key=str)


def test_a_marked_run_loses_one_code_point():
    import zlib

    i = next(i for i in range(10_000) if zlib.crc32(f"{i}:größer".encode()) % 97 == 0)
    at = zlib.crc32(f"{i}:größer".encode()) % 6
    assert dict(spelling.runs_of(i, "Größer GRößER", 97, 5)) == {"größer"[:at] + "größer"[at + 1 :]: 2}
    assert spelling.runs_of(i, "ABCDÀ abcd", 97, 5) == {"abcdÀ": 1}


def test_variants_of_odd_rows(spark):
    rows = {r.word: r.n for r in spelling.variants(odd(spark)).collect()}
    assert rows == {"words": 4}
    assert spelling.variants(odd(spark, [])).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.permutations(range(37)), st.lists(st.tuples(*[st.integers(0, 37)] * 4), min_size=1, max_size=8))
def test_a_wavelet_tree_reports_the_points_of_rectangles(values, boxes):
    tree = WaveletTree(np.array(values))
    a, b, c, d = np.array(boxes).T
    found = sorted(zip(*(x.tolist() for x in tree.report(a, np.maximum(a, b), c, d)), strict=True))
    assert found == sorted((q, v) for q, (i, j, k, m) in enumerate(boxes) for v in values[i : max(i, j)] if k <= v < m)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("abé", min_size=2, max_size=3)), min_size=1, max_size=25, unique=True))
def test_near_words_of_groups(rows):
    group, words = [g for g, _ in rows], [w for _, w in rows]
    pairs = {(int(a), int(b)) for x, y in near(np.array(group), words, np.array([len(w) == 2 for w in words])) for a, b in zip(x, y, strict=True)}
    short = [i for i, w in enumerate(words) if len(w) == 2]
    assert pairs == {(i, j) for i in short for j in range(len(words)) if i != j and group[i] == group[j] and one_edit(words[i], words[j])}


# Alignment


def aligned(docs):
    """By pairs of byte ranges."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    known = alignment._both(vocabulary(), PIECES).tokens
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    made, counts = [], Counter()
    for i, text in docs:
        sides = []
        for table, ids in zip(known, (tokenizer.encode(f" {text}", add_special_tokens=False).ids, sp.encode(text)) if text else ([], []), strict=True):
            at, side = 0, []
            for x in ids:
                side.append((at, at + len(table[x]), x))
                at += len(table[x])
            sides.append(side if b"".join(table[x] for x in ids) == f" {text}".encode() else [])
        a, b = sides if all(sides) else ([], [])
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [tuple(",".join(str(x) for s, e, x in side if lo <= s and e <= hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(x, y) for s, e, x in a for t, f, y in b if s < f and t < e]
        counts.update(links)
        made.append((i, a, b, groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(
        (i, len(a), len(b), len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join("|".join(x) for x in g).encode()).hexdigest() if a else "")
        for i, a, b, g, links in made
    )


TEXTS = ["", "a", " a", "two  spaces\n\nand lines \n x", "tail ", "\n", "Überlänge — naïve ﬁ 東京 🙂🙂", "<|endoftext|> x<s>", "▁ marked", "tab\tand\x00nul", "x" * 60, "antidisestablishmentarianism"]


@pytest.mark.parametrize(("span", "frequent"), [(16_384, 1_000_000), (16, 20), (1, 1)])
def test_alignment_is_that_of_all_pairs_of_byte_ranges(spark, span, frequent, monkeypatch):
    docs = [*enumerate(TEXTS), (50, " ".join(TEXTS) * 2)]
    monkeypatch.setattr(alignment, "SPAN", span)
    rows = alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), frequent=frequent).collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows) == aligned(docs)


@pytest.mark.parametrize("span", [7, 40, 399])
def test_a_sweep_is_the_same_in_portions(span):
    rng = random.Random(5)
    docs = []
    for d in range(5):
        ends = [np.array(sorted({*rng.sample(range(1, 400), 150), 400})) for _ in range(2)]
        docs.append(((d, d), ends, [np.array([rng.randrange(120) for _ in x]) for x in ends]))
    docs.insert(2, ((9, 9), [np.zeros(0, int)] * 2, [np.zeros(0, int)] * 2))
    lengths = [[np.diff(x, prepend=0) for x in ends] for _, ends, _ in docs]
    whole = alignment.Sweep(120)
    joined = [[np.concatenate([d[side] for d in x]) for side in (0, 1)] for x in (lengths, [ids for _, _, ids in docs])]
    whole.take([o for o, _, _ in docs], [[len(x[side]) for x in lengths] for side in (0, 1)], *joined)
    whole.close()
    parts = alignment.Sweep(120)
    for (owner, ends, ids), long in zip(docs, lengths, strict=True):
        for lo in range(0, 400, span):
            some = [(x > lo) & (x <= lo + span) for x in ends]
            parts.take([owner], [[int(m.sum())] for m in some], [x[m] for x, m in zip(long, some, strict=True)], [x[m] for x, m in zip(ids, some, strict=True)])
    parts.close()
    rows = lambda s: [r[:7] for r in s.done if r[6] is not None]
    assert rows(whole) == rows(parts) and len(rows(whole)) == 6

    def pairs(sweep):
        found = Counter()
        for r in sweep.done:
            if r[6] is None:
                for a, b, n in zip(np.cumsum(np.frombuffer(r[7], "<u4")).tolist(), np.frombuffer(r[8], "<u4").tolist(), r[9].tolist(), strict=True):
                    found[r[0], a, b] += n
        return found

    assert pairs(whole) == pairs(parts) and sum(pairs(whole).values()) == sum(r[5] for r in rows(whole))
    for row, (owner, ends, ids) in zip(rows(whole), docs, strict=True):
        cuts = sorted({*ends[0].tolist()} & {*ends[1].tolist()})
        text = ";".join("|".join(",".join(str(i) for e, i in zip(x.tolist(), y.tolist(), strict=True) if lo < e <= hi) for x, y in zip(ends, ids, strict=True)) for lo, hi in zip([0, *cuts], cuts, strict=False))
        assert row == (*owner, len(ids[0]), len(ids[1]), len(cuts), len({*ends[0].tolist()} | {*ends[1].tolist()}), hashlib.sha256(text.encode()).hexdigest() if cuts else "")


PIECE = PieceEncoder(PIECES, most_bytes=3_000)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tabé▁'.1"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_pieces_by_parts_are_those_of_whole_texts(texts):
    assert PIECE.by_parts
    assert [x.tolist() for x in PIECE.batch(texts)] == PIECE.model.encode(texts)


@settings(max_examples=100, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n<|endoftext|>ab"), st.characters(codec="utf-8")), max_size=30))
def test_plain_ids_stand_for_the_text(text):
    plain = encoder(vocabulary(), plain=True)
    ids = plain.batch([text + "<|endoftext|>"])[0].tolist()
    assert b"".join(map(plain.token_bytes().__getitem__, ids)) == f"{text}<|endoftext|>".encode() and 50256 not in ids


BOTH = alignment.Both(vocabulary(), PIECES, most_bytes=3_000)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tabé▁'.1"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_words_of_both_tokenizers_are_those_of_whole_texts(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    for text, found in zip(texts, BOTH.batch(texts), strict=True):
        whole = [tokenizer.encode(f" {text}", add_special_tokens=False).ids, PIECE.model.encode(text)]
        same = text and BOTH._same(f" {text}".encode(), tuple(map(np.array, whole)))
        assert [x.tolist() for x in found] == (whole if same else [[], []])


def test_alignment_of_odd_rows(spark):
    rows = alignment.align(odd(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _, _ in ODD)
    zeros = [r for r in rows if not r.n_a]
    assert len(zeros) == 2 and all(r.groups_sha256 == "" and (r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (0,) * 5 for r in zeros)
    assert alignment.align(odd(spark, [])).collect() == []


# Mixing


def test_the_mix_has_the_rows_of_its_sql(spark):
    assert of_spark(queries.op13_mixing(spark, SF)) == of_sql(duck(SF), mixing.SQL)


def test_a_mix_meets_its_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    docs = [(i, "w " * rng.choice([0, 1, 5, 40, 41]), rng.choice(["hot"] * 5 + ["a", "b", "c", "é", None])) for i in range(3_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.taken_words(table).collect()
    source = {i: s for i, _, s in docs}
    taken, sizes, target = Counter(), Counter(), {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
    assert {source[r.doc_id]: r.source_size for r in rows} == dict(sizes)
    total = sum(sizes.values())
    assert sum(target.values()) == pytest.approx(1.5 * total) and sum(taken.values()) <= 1.5 * total
    weights = dict(zip(sorted(s for s in sizes if s) + [None], [5, 2, 1, 5, 2, 1], strict=True))
    free = {target[s] / weights[s] for s in sizes if target[s] < 2 * sizes[s]}
    assert max(free) == pytest.approx(min(free)) and all(2 * sizes[s] <= min(free) * weights[s] + 1e-6 for s in sizes if target[s] == 2 * sizes[s])
    assert all(abs(taken[s] - target[s]) <= 100 for s in sizes)
    again = mixing.taken_words(table.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_the_queue_is_in_order_of_finish_times_without_gaps(spark):
    docs = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(900)]
    rows = mixing.queue(spark.createDataFrame(docs, "doc_id long, text string, source string")).orderBy("start").collect()
    assert all(a.finish <= b.finish and a.start + a.size == b.start for a, b in zip(rows, rows[1:], strict=False)) and rows[0].start == 0
    taken = [r.taken for r in rows]
    assert taken == sorted(taken, reverse=True)


def test_mixes_of_odd_rows(spark):
    rows = mixing.taken_words(odd(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _, _ in ODD)
    assert {r.taken for r in rows if not r.size} == {0} and all(r.taken <= 2 * r.size for r in rows)
    many = mixing.taken_words(odd(spark, [(None, "same words", "a")] * 500)).agg(F.count("*"), F.sum("taken")).first()
    assert tuple(many) == (500, 1_500)
    assert mixing.taken_words(odd(spark, [])).collect() == []
    assert [tuple(r) for r in mixing.taken_words(odd(spark, [(1, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]
    with pytest.raises(ValueError):
        mixing.queue(odd(spark), share=3.0)
