"""From raw documents to packed training sequences: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ripplet.llm import decontaminate, line_crf, line_dedup, near_dup, packing
from ripplet.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts fail them; rows go by their own text, so null and
    repeated doc_ids need no care; long texts are judged whole; no rows give none."""
    return line_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that came before; those of which nothing is left go, and so do null texts. Rows that
    repeat doc_id and text are one document and keep the same lines; null doc_ids come last."""
    done = line_dedup.dedup_lines(docs).select(*docs.columns)
    return done.where(r"text rlike r'[^\x20\x09-\x0D]'")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8 or more): the least doc_id. Of repeated
    rows one stays; null doc_ids take part and come last; texts without words stand alone."""
    return near_dup.without_copies(docs, 5, 80, bands=40)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Each row goes by its own text, null texts stay, null items are left out;
    an empty benchmark takes nothing away."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 1024 tokens. Null texts are an end id alone; each repeated row
    and each null doc_id is packed."""
    return packing.pack(docs, 1024)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark),
    ("packing", packed),
]

#: The stages label lines, encode tokens and match edits, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
