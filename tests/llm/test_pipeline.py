import random

import corpus_pipeline
from ripplet.llm import decontaminate, line_crf, packing
from tests.llm import brute
from tests.llm.test_dedup import SCHEMA, prose


def test_each_stage_and_the_run_have_the_rows_of_brute_force(spark, tmp_path):
    rng = random.Random(11)
    items = [(k, " ".join(prose(rng, 25))) for k in range(2)]
    clean = [". ".join(" ".join(prose(rng, 12)) for _ in range(6)) + "." for _ in range(12)]
    texts = ["\n".join(x.split(". ")) for x in clean]
    texts += [texts[0], texts[1] + " more", texts[2].replace("a", "e", 1), "Short.\nShort!\n" + texts[3], texts[4] + "\n" + items[0][1], " ".join(prose(rng, 30)) + " " + items[1][1], "### $$$ | | |", ""]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 18), 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def rows(df):
        return sorted((r.doc_id, r.text) for r in df.collect())

    stages = dict(corpus_pipeline.STAGES)
    judged = line_crf.quality_rules(frame, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    good = [(i, t) for i, t in docs if i in {r.doc_id for r in judged if r.kept}]
    assert rows(stages["quality_rules"](spark, frame, str(tmp_path))) == good and 0 < len(good) < len(docs)

    def lines(docs):
        return [(i, t) for (i, _), t in zip(docs, brute.line_keep(docs), strict=True) if brute.WORD.search(t)]

    def near(docs):
        group = brute.near(docs, 5, 80)
        return [(i, t) for i, t in docs if group[i] == i]

    def unlike(docs):
        return [(i, t) for i, t in docs if not any(brute.edit_in(decontaminate.plain(x), decontaminate.plain(t)) <= len(x) // 20 for _, x in items)]

    for name, plain in (("line_dedup", lines), ("near_dedup", near), ("decontamination", unlike)):
        assert rows(stages[name](spark, frame, str(tmp_path))) == plain(docs) != docs
    left = unlike(near(lines(good)))
    packed = [tuple(r) for r in packing.pack(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in left], SCHEMA), 1024).orderBy("doc_id", "piece").collect()]
    done = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "piece").collect()]
    assert {r[0] for r in done} == {i for i, _ in left} and [r[:5] for r in done] == [r[:5] for r in packed]
