"""Quality rules: word statistics of whole texts, and lines labelled by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.encoding import portions

SYMBOLS = "#*$%&|<>"
FEATURES = ("bias", "symbols", "capitals", "shouts", "digits", "short", "length", "sentence", "repeat", "word_length", "monotony")
#: Weights of the state `content` against `boilerplate` before any label is seen, and the mean they are shrunk towards.
PRIOR = np.array([1.5, -4.0, -4.0, -4.0, -2.0, -0.5, 0.5, 0.5, -1.0, 0.0, -1.0])
#: Log-potentials of staying in a state, of a change, and of content at the start.
CHAIN = np.array([1.0, -1.0, 0.5])
_DROP = bytes(range(256))
_SPACE, _SYMBOL = b" \t\n\v\f\r", SYMBOLS.encode()


def word_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: none)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    space = len(raw) - len(raw.translate(None, _SPACE))
    symbols = len(raw) - len(raw.translate(None, _SYMBOL))
    seen: set[bytes] = set()
    repeats = 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in seen:
                repeats += 1
            elif line.strip(_SPACE):
                seen.add(line)
    again = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        if len(number) < n or n > 2_000_000:
            pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
            three = pair[:-1] * len(number) + ids[2:]
            _, back, count = np.unique(three, return_inverse=True, return_counts=True)
            double = count[back] > 1
            mark = np.zeros(n, bool)
            for j in range(3):
                mark[j : n - 2 + j] |= double
            again = int(mark.sum())
    return n, len(text) - space, symbols, repeats, again


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES and the number of characters for each line that has a word."""
    rows, size, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        n, chars = len(words), len(line)
        raw = line.encode()
        symbols = len(raw) - len(raw.translate(None, _SYMBOL))
        upper = sum(map(str.isupper, words))
        bare = line.rstrip()
        rows.append((1.0, min(1.0, symbols / n), upper / n, min(1.0, line.count("!") / n), min(1.0, sum(map(line.count, "0123456789")) / n), float(n < 4), min(2.0, np.log1p(n) / 3), float(bare[-1:] in ".!?:;\"'"), float(line in seen), min(3.0, chars / n / 6), 1 - len(set(words)) / n))
        seen.add(line)
        size.append(chars)
    return np.array(rows, float).reshape(-1, len(FEATURES)), np.array(size, float)


def viterbi(scores: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """The best labelling (1: content) where scores are content's log-potentials against boilerplate."""
    stay, change, first = chain
    back = np.zeros((len(scores), 2), bool)
    a, b = 0.0, float(scores[0]) + first
    for i, s in enumerate(scores[1:].tolist(), 1):
        back[i] = (b + change > a + stay, b + stay > a + change)
        a, b = max(a + stay, b + change), max(b + stay, a + change) + s
    out = np.zeros(len(scores), bool)
    now = b > a
    for i in range(len(scores) - 1, -1, -1):
        out[i] = now
        now = back[i, int(now)]
    return out


def _marginals(scores: list[np.ndarray], chain: np.ndarray, cells: int = 400_000) -> tuple[list[np.ndarray], np.ndarray]:
    """P(content) of each line, and the expected stays, changes and contents at the start. Sequences of like length go
    together, as many as make `cells` lines with their padding, so that one long text makes no grid of all its size."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.zeros(0)] * len(scores)
    total, at = np.zeros(3), 0
    while at < len(order):
        some = order[at : at + max(1, cells // len(scores[order[at]]))]
        found, expected = _grid([scores[i] for i in some], chain)
        for i, p in zip(some, found, strict=True):
            out[i] = p
        total, at = total + expected, at + len(some)
    return out, total


def _grid(scores: list[np.ndarray], chain: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """_marginals() by forward-backward over all sequences at once, the longest first."""
    order = np.argsort([-len(s) for s in scores], kind="stable")
    lengths = np.array([len(scores[i]) for i in order])
    most = lengths[0]
    grid = np.zeros((len(scores), most, 2))
    for row, i in enumerate(order):
        grid[row, : len(scores[i]), 1] = scores[i]
    grid[:, 0, 1] += chain[2]
    move = np.array([[chain[0], chain[1]], [chain[1], chain[0]]])
    alive = [int((lengths > t).sum()) for t in range(most)]
    alpha, beta = grid.copy(), np.zeros_like(grid)
    for t in range(1, most):
        k = alive[t]
        alpha[:k, t] += np.logaddexp(alpha[:k, t - 1, :1] + move[0], alpha[:k, t - 1, 1:] + move[1])
    for t in range(most - 2, -1, -1):
        k = alive[t + 1]
        nxt = grid[:k, t + 1] + beta[:k, t + 1]
        beta[:k, t] = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
    total = np.logaddexp(alpha[:, 0, 0] + beta[:, 0, 0], alpha[:, 0, 1] + beta[:, 0, 1])
    p = np.exp(alpha + beta - total[:, None, None])[:, :, 1]
    stays = changes = 0.0
    for t in range(1, most):
        k = alive[t]
        joint = np.exp(alpha[:k, t - 1, :, None] + move + (grid[:k, t] + beta[:k, t])[:, None, :] - total[:k, None, None])
        same = joint[:, 0, 0].sum() + joint[:, 1, 1].sum()
        stays, changes = stays + same, changes + joint.sum() - same
    out: list[np.ndarray] = [np.zeros(0)] * len(scores)
    for row, i in enumerate(order):
        out[i] = p[row, : len(scores[i])]
    return out, np.array([stays, changes, p[:, 0].sum()])


def fit(texts: list[str], good: list[bool], rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the field from labelled documents. Lines of good documents are content unless they repeat a line of
    their document; lines of bad ones are boilerplate. Gradient ascent on the penalized likelihood, from the prior."""
    weights, chain = PRIOR.copy(), CHAIN.copy()
    pairs = [(line_features(t)[0], g) for t, g in zip(texts, good, strict=True)]
    pairs = [(x, g) for x, g in pairs if len(x)]
    if not pairs or len({g for _, g in pairs}) < 2:
        return weights, chain
    rows = np.concatenate([x for x, _ in pairs])
    truth = [(x[:, 8] == 0) & g for x, g in pairs]
    labels = np.concatenate(truth).astype(float)
    held = np.zeros(3)
    for t in truth:
        same = int((t[1:] == t[:-1]).sum())
        held += (same, len(t) - 1 - same, float(t[0]))
    cuts = np.cumsum([len(x) for x, _ in pairs])[:-1]
    prior = np.concatenate([PRIOR, CHAIN])
    value, first, second = prior.copy(), np.zeros_like(prior), np.zeros_like(prior)
    for step in range(1, rounds + 1):
        p, expected = _marginals(np.split(rows @ value[:-3], cuts), value[-3:])
        slope = np.concatenate([rows.T @ (labels - np.concatenate(p)), held - expected]) / len(pairs) - 0.02 * (value - prior)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        value += 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return value[:-3], value[-3:]


def content_share(text: str, weights: np.ndarray, chain: np.ndarray) -> float:
    """The share of characters in lines labelled content, of those in lines with a word; 0 without any."""
    rows, size = line_features(text)
    return float(size[viterbi(rows @ weights, chain)].sum() / size.sum()) if len(rows) else 0.0


def _judge(weights: np.ndarray, chain: np.ndarray, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.float64())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in portions(texts):
                rows = []
                for text in texts[part]:
                    stats = word_stats(text)
                    failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
                    share = content_share(text or "", weights, chain)
                    rows.append((*stats, failed, not failed and share >= least, share))
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", *STATS, "base_failed", "kept", "content_share"])

    return judge


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def labelled(docs: DataFrame, labels: DataFrame, sample: int, what: str = "quality") -> list:
    """(text, label) of at most `sample` labelled documents, those whose doc_id hashes least."""
    picked = labels.where(f"doc_id is not null and {what} is not null").groupBy("doc_id").agg(F.max(what).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return rows.orderBy("doc_id").collect()


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, sample: int = 600, least_content: float = 0.5) -> DataFrame:
    """Word statistics, base rules and the field's verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share. A null
    text has no words and fails. The field is fitted to at most `sample` labelled documents (doc_id, quality); with no
    labels of both kinds it keeps its prior weights; long texts are fitted and judged whole. A document is kept if it passes the base rules and at least
    `least_content` of its characters are in content lines. Null or repeated doc_ids each get their row; other columns
    are ignored; an empty table gives no rows.
    """
    known = labelled(docs, labels, sample) if labels is not None else []
    weights, chain = fit([r["text"] for r in known], [r["label"] > 0 for r in known])
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judge(weights, chain, least_content), schema)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, sample: int = 600, least_content: float = 0.5) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns: each text is judged where it is read."""
    known = labelled(docs, labels, sample) if labels is not None else []
    weights, chain = fit([r["text"] for r in known], [r["label"] > 0 for r in known])
    judge = _judge(weights, chain, least_content)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            verdicts = judge(iter([pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], ["doc_id", "text"])]))
            mask = [k for x in verdicts for k in x.column("kept").to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
