"""Best-fit packing by large-item matching.

Pieces longer than a third of the capacity go at most two to a sequence: each is matched with the longest other one
that still fits. Shorter pieces then go, longest first, into the sequence with the least sufficient gap. The plan
needs the number of pieces of each length only (at most `capacity` numbers), whatever the corpus; Spark carries it out.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import gapless_rank, written
from ripplet.llm.encoding import encoder, portions, vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tail = encoder(path), np.array([end], "<u4")
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in portions(texts):
                rows = []
                for key, ids in zip(keys[part], code.batch(texts[part]), strict=True):
                    ids = np.concatenate([ids, tail])
                    first = (len(ids) - 1) % capacity + 1
                    for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                        start = max(0, stop - capacity)
                        rows.append((key, k, start, stop - start, zlib.crc32(ids[start:stop].astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return cut


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, pieces, first sequence, offset) of runs: the pieces of a length with numbers from the first
    on go, one each, into sequences from the first on, all at one offset."""
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # gap -> (sequences, lengths in each)
    sizes: list[int] = []  # gaps in ascending order

    def put(gap: int, number: int, held: tuple[int, ...]) -> None:
        if gap not in gaps:
            bisect.insort(sizes, gap)
            gaps[gap] = []
        gaps[gap].append((number, held))

    def pop(gap: int) -> tuple[int, tuple[int, ...]]:
        found = gaps[gap].pop()
        if not gaps[gap]:
            del gaps[gap]
            sizes.remove(gap)
        return found

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            at = bisect.bisect_right(large, min(n, capacity - n)) - 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            mate = large[at] if at >= 0 else 0
            if not mate or (mate == n and left[n] < 2):
                put(capacity - n, left[n], (n,))
                left[n] = 0
                continue
            number = left[n] // 2 if mate == n else min(left[n], left[mate])
            left[n] -= number
            left[mate] -= number
            put(capacity - n - mate, number, (n, mate))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(sizes, n)
            if at < len(sizes):
                gap = sizes[at]
                number, held = pop(gap)
                used = min(number, left[n])
                each = 1 if used < number or left[n] < 2 * number else min(gap // n, left[n] // number)
                if used < number:
                    put(gap, number - used, held)
                put(gap - each * n, used, (*held, *[n] * each))
                left[n] -= used * each
            else:
                each = min(capacity // n, left[n])
                number = left[n] // each
                put(capacity - each * n, number, (n,) * each)
                left[n] -= number * each
    runs, sequence, used_up = [], 0, dict.fromkeys(counts, 0)
    for gap in sizes:
        for number, held in gaps[gap]:
            offset = 0
            for n in held:
                runs.append((n, used_up[n], number, sequence, offset))
                used_up[n] += number
                offset += n
            sequence += number
    return runs


def _place(runs: list[tuple[int, int, int, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    key = table[:, 0] * 2**44 + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(5).to_numpy()
            at = np.searchsorted(key, batch.column(3).to_numpy() * 2**44 + number, "right") - 1
            sequence = table[at, 3] + number - table[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(table[at, 4])], [*PIECES.replace(" long", "").replace(" int", "").split(", "), "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """Every document's pieces and their places in sequences of at most `capacity` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is empty: the end id alone. A
    document longer than `capacity` is cut; all its pieces but the first have that length. Null doc_ids are kept,
    repeated rows are packed each; other columns are ignored. No documents: no rows.
    """
    pieces = written(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer or vocabulary(), end, capacity), PIECES), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    numbered = gapless_rank(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "__number")
    columns = [x.split()[0] for x in PIECES.split(", ")]
    return numbered.select(*columns, "__number").mapInArrow(_place(plan(counts, capacity)), PIECES + ", sequence_id long, offset long")
