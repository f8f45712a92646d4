"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm import alignment, decontaminate, html_text, kd_shards, line_crf, line_dedup, mixing, near_dup, packing, repeats, site_quality, spelling, token_files
from ripplet.llm.common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeated strings of 400 bytes cover."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, its own evidence shrunk to its path, host and all documents."""
    return site_quality.site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base statistics and the verdict of the line labels."""
    return line_crf.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 24 shards of near equal bytes."""
    return kd_shards.shards(table(spark, sf_dir, "documents"), 24)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, read back from them."""
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the edits."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near copies, five words, 85 %."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), 5, 85)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that came before, as a digest."""
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), 1024)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words' number, its form and its root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, how the tokens of byte_bpe_50k.json and piece_bpe_32k.model align."""
    done = alignment.align(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, how many words the mix takes of it, beside its source's size and target."""
    return mixing.taken_words(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_quality_classifier,
        op3_quality_rules,
        op4_sharding,
        op5_token_files,
        op6_decontamination,
        op7_near_dedup,
        op8_html_extraction,
        op9_line_dedup,
        op10_packing,
        op11_spelling_variants,
        op12_tokenizer_alignment,
        op13_mixing,
    )
}

#: DuckDB SQL for those that SQL can express on whole tables; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op13_mixing": mixing.SQL}
