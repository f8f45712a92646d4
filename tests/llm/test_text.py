import random

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplet.llm import decontaminate, encoding, html_text, kd_shards, line_crf, packing, site_quality, token_files
from tests.llm import brute
from tests.llm.test_dedup import prose, table

ODD = st.text(alphabet="aB1 \n\t'.#\x1c\x85　é中<|>", max_size=80)


@given(ODD)
@settings(max_examples=200, deadline=None)
def test_word_stats_are_those_of_brute_force(text):
    assert line_crf.word_stats(text) == brute.word_stats(text)


@given(st.lists(ODD, max_size=4))
@settings(max_examples=200, deadline=None)
def test_encoder_has_the_ids_of_whole_texts(texts):
    code = encoding.encoder(encoding.vocabulary())
    assert [x.tolist() for x in code.batch(texts)] == [code.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_viterbi_is_the_best_of_all_labellings():
    import itertools

    import numpy as np

    rng, chain = np.random.default_rng(3), np.array([0.7, -0.4, 0.2])
    for _ in range(20):
        s = rng.normal(size=7)

        def value(y, s=s):
            return sum(a for a, b in zip(s, y, strict=True) if b) + chain[2] * y[0] + sum(chain[0] if a == b else chain[1] for a, b in zip(y, y[1:], strict=False))

        best = max(itertools.product([0, 1], repeat=7), key=value)
        assert line_crf.viterbi(s, chain).astype(int).tolist() == list(best)


def labelled(spark, n: int):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        good = i % 2
        lines = [" ".join(prose(rng, 12)) + "." if good else "### $$$ BUY NOW %%% ||| 99" for _ in range(8)]
        docs.append((i, "\n".join(lines) + ("" if good else " " + " ".join(prose(rng, 80)))))
        labels.append((i, good, 0))
    return table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_stage_keeps_what_the_rules_keep(spark):
    docs, labels = labelled(spark, 40)
    kept = {r.doc_id for r in line_crf.quality_rules(docs, labels).collect() if r.kept}
    assert kept and {r.doc_id for r in line_crf.keep_good(docs, labels).collect()} == kept
    assert {i for i in range(40) if i % 2} <= kept


def test_quality_of_nothing_and_of_null_texts(spark):
    assert line_crf.quality_rules(table(spark, [])).collect() == []
    row = line_crf.quality_rules(table(spark, [(1, None)])).first()
    assert row.n_words == 0 and row.base_failed and not row.kept


def test_site_quality_on_held_out_labels(spark):
    docs, labels = labelled(spark, 80)
    rows = site_quality.site_quality(docs, labels.where("doc_id < 40")).where("doc_id >= 40").collect()
    assert sum(r.kept == bool(r.doc_id % 2) for r in rows) == 40
    assert site_quality.site_quality(table(spark, []), labels).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_are_near_equal_and_slots_gapless(spark, seed):
    rng = random.Random(seed)
    docs = [(i, "x" * rng.randrange(0, 300)) for i in range(600)] + [(1000, None)]
    rows = kd_shards.shards(table(spark, docs), 24).collect()
    size, slots = {}, {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 601 and set(size) == set(range(24))
    assert max(size.values()) - min(size.values()) <= 5 * 308
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_of_nothing(spark):
    assert kd_shards.shards(table(spark, []), 24).collect() == []


@given(st.lists(st.integers(0, 2**40), max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano_returns_its_values(values):
    import numpy as np

    values = sorted(values)
    code = token_files.EliasFano(token_files.ef_encode(np.array(values, np.uint64)))
    assert code.all().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values


def ids_of(docs):
    code = encoding.encoder(encoding.vocabulary()).tokenizer
    return {i: [*code.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs}


def some_docs() -> list[tuple[int, str | None]]:
    rng = random.Random(4)
    return [(9, None), (3, ""), *[(20 + i, " ".join(prose(rng, rng.randrange(1, 500)))) for i in range(40)], (5, "w " * 9000)]


def test_token_files_return_every_document(spark):
    docs, at = some_docs(), 0
    rows = {r.doc_id: r for r in token_files.token_files(table(spark, docs)).collect()}
    for i, ids in sorted(ids_of(docs).items()):
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert token_files.token_files(table(spark, [])).collect() == []


def test_packing_places_every_piece_once(spark):
    docs = some_docs()
    ids, held, bins = ids_of(docs), {}, {}
    for r in packing.pack(table(spark, docs), 1024).collect():
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length])
        held.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        assert sum(n for *_, n in held[i]) == len(x) and len(held[i]) == -(-len(x) // 1024)
    for x in bins.values():
        ends = [0, *[a + n for a, n in sorted(x)]]
        assert [a for a, _ in sorted(x)] == ends[:-1] and ends[-1] <= 1024
    assert len(bins) <= 1.1 * sum(map(len, ids.values())) / 1024 + 1
    assert packing.pack(table(spark, []), 1024).collect() == []


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(6)
    items = [(k, " ".join(prose(rng, 25))) for k in range(10)] + [(10, None), (11, "")]
    docs: list[tuple[int, str | None]] = [(0, None), (1, "")]
    for i in range(2, 40):
        text = list(" ".join(prose(rng, 60)))
        if i % 3 == 0:
            inside = list(items[i % 10][1])
            for _ in range(i % 8):
                inside[rng.randrange(len(inside))] = "Z"
            text[100:100] = [" ", *inside, " "]
        docs.append((i, "".join(text)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(table(spark, docs), benchmark).collect()}
    expected = {}
    for i, t in docs:
        for k, x in items[:10]:
            n = brute.edit_in(decontaminate.plain(x), decontaminate.plain(t))
            if n <= decontaminate.budget(len(decontaminate.plain(x)), 0.05):
                expected[i, k] = n
    assert expected and got == expected
    left = {r.doc_id for r in decontaminate.decontaminate(table(spark, docs), benchmark).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in expected}


def test_decontamination_finds_short_items_with_an_edit_and_longer_ones_with_a_word_or_marks_changed(spark):
    rng = random.Random(7)
    short = [(k, "".join(rng.choice("abcdefghij klmnop") for _ in range(20 + k)).replace("  ", "xy").strip().ljust(20 + k, "z")) for k in range(10)]
    long = [(k, " ".join(prose(rng, 20))) for k in range(10, 20)]
    docs = [(k, "before " + x[:9] + "#" + x[10:] + " after") for k, x in short]
    docs += [(k, "so " + x.replace(x.split()[5], "word", 1)) for k, x in long] + [(k + 10, x.replace(" ", ", ", 4) + ".") for k, x in long]
    benchmark = spark.createDataFrame(short + long, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(table(spark, docs), benchmark).collect()}
    expected = {(i, k): n for i, t in docs for k, x in short + long if (n := brute.edit_in(decontaminate.plain(x), decontaminate.plain(t))) <= len(decontaminate.plain(x)) // 20}
    assert got == expected and all((k, k) in got for k, _ in short) and all((k + 10, k) in got and (k, k) in got for k, _ in long)


def test_decontamination_goes_by_rows_where_ids_are_null_or_repeated(spark):
    rng = random.Random(8)
    item, clean, other = (" ".join(prose(rng, 25)) for _ in range(3))
    docs = [(None, "a " + item), (None, clean), (4, item + " b"), (4, other), (5, None)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.decontaminate(table(spark, docs), benchmark).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted((str(i), str(t)) for i, t in [docs[1], docs[3], docs[4]])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='ad'>Buy, now.</div><article><h1>A title</h1><p>One, two &amp; three\n four.<br><p>Five, six.</article><div class='comments'><p>First, post.</div><footer>End.</footer></body></html>", "A title One, two & three four. Five, six."),
        ("<body><script>var t='</p>';</script><div id=main><p>Some text, long enough, to be the main one.</p><p>More.</p></div><aside><p>Side, text.</p></aside>", "Some text, long enough, to be the main one. More."),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


WRAPS = ["class='content-sidebar-wrap'", "class='page has-sidebar'", "id='page' class='ad-free'", "class='sidebarWrap'"]


@pytest.mark.parametrize(("article", "name"), [(a, n) for a in ("article", "main", "div") for n in WRAPS] + [(a, n) for a in ("article", "main") for n in ("class=sidebar", "id=widget")])
def test_main_text_is_not_lost_by_the_name_of_a_wrapper(article, name):
    text = "Some text, long enough, to be the main one."
    page = f"<body><div {name}><{article}><h1>T</h1><p>{text}</p><section class='related-work'><p>Others, too.</p></section></{article}></div><div class=ad>Buy, now.</div><div class='site-footer'><a href=x>Terms of use.</a></div></body>"
    assert html_text.main_text(page) == f"T {text} Others, too."


def test_main_text_leaves_out_named_elements_and_linked_doubtful_ones():
    page = "<body><article><p>The text, of it.</p><div class='x related'>See, this.</div><div class='link-list related-links'><a href=x>One, two.</a></div></article><div class='related'><article><p>A teaser, of another page.</p></article></div><div class='cookie-bar'>We use cookies.</div></body>"
    text = html_text.main_text(page)
    assert text.startswith("The text, of it.") and "See" not in text and "One" not in text and "cookies" not in text


@pytest.mark.parametrize("outer", ["<article>{}</article>", "<main><div>{}</div></main>", "<body><div>{}</div><div><a href=x>Next, one.</a></div></body>"])
def test_main_text_keeps_the_same_parts_of_short_and_long_pages(outer):
    para = "<p>" + "Some words of prose, and more of them, to fill a line of text. " * 5 + "</p>"
    parts = ["A title", "A short lead", "First item", "A quote", "Short section.", "A heading"]
    for n in (4, 10, 80):
        body = f"<h1>{parts[0]}</h1><p>{parts[1]}</p><ul><li>{parts[2]}</ul><div>{para * n}</div><blockquote>{parts[3]}</blockquote><section>{parts[4]}</section><h2>{parts[5]}</h2><p>Last words</p><h2>More of this</h2><ul><li><a href=y>Other page</a></ul>"
        text = html_text.main_text(outer.format(body))
        assert [x for x in parts if x not in text] == [] and text.count("Some words") == 5 * n and "Next, one" not in text
        assert ("Other page" in text) == ("body" not in outer) and ("More of this" in text) == ("body" not in outer)


def test_main_text_of_body_level_parts_and_an_articles_header():
    para = "<p>" + "Some text, long enough, to be the main one. " * 4 + "</p>"
    inner = f"<h1>T</h1>{para}<p>Short line.</p>{para}<h2>Second</h2><p>Brief words</p>"
    around = "<nav><a href=x>Menu</a></nav><header><p>Site, name.</p></header>{}<div class=sidebar><p>Side, text.</p></div>"
    for outer in ("{}", "<div data-id='ad-41'>{}</div>", "<div class='layout has-sidebar'>{}</div>", "<div class='elementor-widget x-post-content'>{}</div>"):
        text = html_text.main_text("<body>" + around.format(outer.format(inner)))
        assert text.startswith("T Some") and text.endswith("Second Brief words") and "Short line." in text
    text = html_text.main_text(f"<article><header><h1>T</h1><p>By someone, yesterday.</p></header>{para}</article>")
    assert text.startswith("T Some") and "someone" not in text


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '\"", "<!x", "</b ", "<a b='<i>"])
def test_main_text_of_a_megabyte_of_broken_markup_takes_little_time(part):
    import time

    start = time.process_time()
    html_text.main_text("<p>Text.</p>" + part * (1_000_000 // len(part)))
    assert time.process_time() - start < 4


def test_extract_keeps_every_row_and_ignores_other_columns(spark):
    page = "<article><p>One, two.</p></article>"
    rows = [(1, "u", page, 1), (1, "u", page, 2), (None, None, page, 3), (2, "v", None, 4), (3, "w", "", 5), (4, "x", "<p>" + "word " * 60_000, 6)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((str(r.page_id), str(r.url), r.n_chars) for r in found) == [("1", "u", 9), ("1", "u", 9), ("2", "v", 0), ("3", "w", 0), ("4", "x", 299_999), ("None", "None", 9)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_marginals_in_parts_are_those_of_one_grid():
    import numpy as np

    rng = np.random.default_rng(1)
    scores = [rng.normal(size=n) for n in (1, 7, 3, 40, 2, 40, 11)]
    whole, parts = line_crf._marginals(scores, line_crf.CHAIN), line_crf._marginals(scores, line_crf.CHAIN, 50)
    assert all(np.allclose(a, b) for a, b in zip(whole[0], parts[0], strict=True)) and np.allclose(whole[1], parts[1])


def test_site_quality_leaves_a_document_out_of_its_own_path(spark):
    docs = spark.createDataFrame([(1, "w " * 80, "h/a"), (2, "w " * 80, "h/b"), (2, "x", "h/b"), (None, None, None)], "doc_id long, text string, source string").withColumn("lang", F.lit(None).cast("string"))
    rows = site_quality.site_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(rows) == 4 and len({r.quality_score for r in rows}) > 0 and all(0 < r.quality_score < 1 for r in rows)


@pytest.mark.parametrize("name", ["comment-list", "comments-area", "ad-slot", "newsletter-signup", "cookie-notice", "post-sidebar", "sidebar-box", "widget-area", "commentList", "reply_form", "adSlot"])
@pytest.mark.parametrize("outer", ["<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>"])
def test_main_text_leaves_out_compound_names(name, outer):
    para = "A sentence of the article, with a comma and some more words in it, is here. "
    body = "".join(f"<p>{para * 2}</p>" for _ in range(4))
    part = f'<div class="{name}"><p>Not of the article, this, but of something else. It is short.</p></div>'
    text = " ".join([(para * 2).strip()] * 4)
    assert html_text.main_text(f"<body>{outer.format(body + part)}</body>") == text
    assert html_text.main_text(f"<body>{outer.format(part + body)}</body>") == text


def test_main_text_leaves_out_comments_however_long():
    para = "<p>" + "A sentence of the article, with a comma and some more words in it, is here. " * 3 + "</p>"
    comments = '<div class="comments-area"><ol>' + "<li><p>A reader says, at length, what others said before. And more, and more.</p></li>" * 60 + "</ol></div>"
    assert html_text.main_text(f"<article><h1>T</h1>{para}{comments}</article>") == "T " + para[3:-4].strip()


@pytest.mark.parametrize("name", ["comment-page", "ad-free", "has-sidebar", "widget-text", "related-work", "content-sidebar"])
def test_main_text_is_not_lost_by_compound_names_of_what_holds_most_of_it(name):
    para = "A sentence of the article, with a comma and some more words in it, is here. "
    inner = "".join(f"<p>{para * 2}</p>" for _ in range(3))
    assert html_text.main_text(f'<body><div class="{name}">{inner}</div><p>End.</p></body>').startswith(" ".join([(para * 2).strip()] * 3))
