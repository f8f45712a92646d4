"""Hierarchical empirical Bayes quality: a document's own evidence, and what its host and path have shown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import written
from ripplet.llm.encoding import portions
from ripplet.llm.line_crf import labelled, line_features, word_stats


def evidence(text: str | None) -> list[float]:
    """What the document classifier sees: shares and logarithms of a whole text's statistics."""
    n, chars, symbols, dup, again = word_stats(text)
    rows, size = line_features(text or "")
    mean = rows.T @ size / size.sum() if len(rows) else np.zeros(11)
    return [1.0, np.log1p(n) / 7, float(n < 50), chars / (n or 1) / 6, min(1.0, symbols / (n or 1)), dup / (len(rows) or 1), again / (n or 1), float(100 * again > 50 * n), *mean[[2, 3, 4, 5, 7, 10]]]


def fit(rows: np.ndarray, labels: np.ndarray, penalty: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge penalty; without labels of both kinds, the base rate alone."""
    weights = np.zeros(rows.shape[1])
    if len(labels) == 0 or labels.min() == labels.max():
        weights[0] = 2.0 if len(labels) == 0 or labels.max() > 0 else -2.0
        return weights
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (labels - p) - penalty * weights
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + penalty * np.eye(len(weights))
        weights += np.linalg.solve(bend, slope)
    return weights


def _score(weights: np.ndarray, n_columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n_columns).to_pylist()
            for part in portions(texts):
                x = np.array([evidence(t) for t in texts[part]])
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -12, 12)))
                yield pa.RecordBatch.from_arrays([*[c[part.start : part.stop] for c in batch.columns[:n_columns]], pa.array(p)], ["doc_id", "host", "path", "p"])

    return score


def _strength(mean: Column, between: Column) -> Column:
    """Pseudo-count of a Beta prior whose mean and variance between groups are given."""
    return F.greatest(F.lit(1.0), F.least(F.lit(1000.0), mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _posteriors(own: Column, n_own: Column) -> tuple[Column, Column]:
    """A host's and a path's mean score without a part of their documents, each shrunk to the level above it."""
    host = (F.col("host_s") - own + F.col("k") * F.col("mean")) / (F.col("host_n") - n_own + F.col("k"))
    return host, (F.col("s") - own + F.col("path_k") * host) / (F.col("n") - n_own + F.col("path_k"))


def site_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = 3000, weight: float = 0.5, least: float = 0.5) -> DataFrame:
    """Every document's quality from its text, host and path.

    Returns doc_id, host, path, doc_score, host_posterior, path_posterior, quality_score, kept. The classifier is fitted
    to at most `sample` labelled documents (doc_id, quality); it scores every whole text. A host's posterior is the mean
    of its documents' scores, shrunk to the corpus mean by a pseudo-count from the spread between hosts; a path's is
    shrunk to its host's. The score adds `weight` times the path's log-odds over the corpus's, as the path's other documents
    give them (the host's if there are none), to the document's own.
    By default the host is `source` up to the first slash, the path what follows up to the next, or lang if nothing does.
    Null hosts or paths are one group, ""; null texts have no words. Null or repeated doc_ids each get their row; other
    columns are ignored; no rows give none. Sums by path are made before each shuffle and join back by a key that AQE can
    split, so a hot host is no burden.
    """
    known = labelled(docs, labels, sample)
    weights = fit(np.array([evidence(r["text"]) for r in known]).reshape(-1, 14), np.array([float(r["label"] > 0) for r in known]))
    source = F.coalesce(F.col("source"), F.lit(""))
    host = F.split(source, "/")[0] if host is None else F.coalesce(host, F.lit(""))
    path = F.coalesce(F.get(F.split(source, "/"), F.lit(1)), F.col("lang"), F.lit("")) if path is None else F.coalesce(path, F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), "text")
    scored = written(rows.mapInArrow(_score(weights, 3), "doc_id long, host string, path string, p double"), "scored")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    # One row: the corpus mean, and the spread of host means around it, weighted by documents.
    whole = hosts.agg(F.sum("host_n").alias("all_n"), F.sum("host_s").alias("all_s"), F.sum(F.col("host_s") ** 2 / F.col("host_n")).alias("squares"))
    mean = F.col("all_s") / F.col("all_n")
    whole = whole.select(mean.alias("mean"), _strength(mean, F.col("squares") / F.col("all_n") - mean**2).alias("k"))
    hosts = hosts.join(F.broadcast(whole))
    paths = paths.join(hosts, "host")
    spread = F.col("n") * (F.col("s") / F.col("n") - F.col("host_s") / F.col("host_n")) ** 2
    inner = paths.agg((F.sum(spread) / F.sum("n")).alias("between"), F.first("mean").alias("m")).select(_strength(F.col("m"), F.col("between")).alias("path_k"))
    paths = paths.join(F.broadcast(inner))
    # What is shown of a group holds all its documents; a document's own score leaves itself out, as it is counted beside.
    host_all, path_all = _posteriors(F.lit(0.0), F.lit(0))
    sums = ("n", "s", "host_n", "host_s", "mean", "k", "path_k")
    paths = paths.select("host", "path", *sums, host_all.alias("host_posterior"), path_all.alias("path_posterior"))
    joined = scored.join(paths, ["host", "path"])
    odds = _logit(F.col("p")) + F.lit(weight) * (_logit(_posteriors(F.col("p"), F.lit(1))[1]) - _logit(F.col("mean")))
    score = F.round(1 / (1 + F.exp(-odds)), 9)
    shown = [F.round(c, 9).alias(n) for c, n in (("p", "doc_score"), ("host_posterior", "host_posterior"), ("path_posterior", "path_posterior"))]
    return joined.select("doc_id", "host", "path", *shown, score.alias("quality_score"), (score >= least).alias("kept"))
