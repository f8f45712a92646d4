"""Token-id files: ids of many documents one after another, their boundaries in Elias-Fano code.

A file holds documents in ascending doc_id order:
  8 bytes magic, then uint64: documents, ids, bytes per id (2 or 4), documents with a null id (they come first),
  length of the doc_id block, length of the boundary block; then both blocks and the ids, all little-endian.
Both blocks are Elias-Fano coded: doc_ids less the least one, and boundaries 0, n1, n1+n2, ...
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplet.llm.common import scratch, written
from ripplet.llm.encoding import encoder, portions, vocabulary

MAGIC = b"EFTOKS01"
#: Every so many values the upper bits' position is stored, for select().
EVERY = 64


def ef_encode(values: np.ndarray) -> bytes:
    """Elias-Fano code of values >= 0 in ascending order; about 2 + log2(last / count) bits a value."""
    values = np.asarray(values, np.uint64)
    n, last = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (last // n).bit_length() - 1) if n else 0
    lower = b""
    if low:
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lower = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    upper[ones] = 1
    upper = np.packbits(upper, bitorder="little").tobytes()
    picks = ones[::EVERY].astype("<u4" if len(upper) < 2**28 else "<u8").tobytes()
    head = np.array([n, low, len(lower), len(upper), len(picks)], "<u8").tobytes()
    return head + lower + upper + picks


class EliasFano:
    """Reads ef_encode()'s bytes; select(i) looks at a few dozen bits, all() decodes everything at once."""

    def __init__(self, data: bytes | memoryview) -> None:
        self.n, self.low, a, b, c = (int(x) for x in np.frombuffer(data, "<u8", 5))
        at = 40
        self.lower = np.frombuffer(data, np.uint8, a, at)
        self.upper = np.frombuffer(data, np.uint8, b, at + a)
        self.picks = np.frombuffer(data, "<u4" if b < 2**28 else "<u8", c // (4 if b < 2**28 else 8), at + a + b)

    def select(self, i: int) -> int:
        start, need = int(self.picks[i // EVERY]), i % EVERY
        byte, here = start // 8, start % 8
        seen = -1
        while True:
            ones = np.flatnonzero(np.unpackbits(self.upper[byte : byte + 64], bitorder="little")[here:])
            if seen + len(ones) >= need:
                high = byte * 8 + here + int(ones[need - seen - 1]) - i
                break
            seen, byte, here = seen + len(ones), byte + 64, 0
        first = i * self.low
        word = int.from_bytes(self.lower[first // 8 : (first + self.low + 7) // 8].tobytes(), "little")
        return high << self.low | word >> first % 8 & (1 << self.low) - 1

    def selects(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1; each block of EVERY is found by its stored position."""
        out = []
        for block in range(i // EVERY, -(-j // EVERY)):
            start = int(self.picks[block])
            stop = int(self.picks[block + 1]) if block + 1 < len(self.picks) else 8 * len(self.upper)
            bits = np.unpackbits(self.upper[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :]
            first = block * EVERY
            n = min(EVERY, self.n - first)
            value = np.flatnonzero(bits)[:n] + start - np.arange(first, first + n)
            if self.low:
                at = first * self.low // 8  # whole bytes, as EVERY is a multiple of 8
                lower = np.unpackbits(self.lower[at : at + -(-n * self.low // 8)], bitorder="little")[: n * self.low]
                value = value << self.low | lower.reshape(n, self.low).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
            out.append(value[max(0, i - first) : j - first])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low:
            return high.astype(np.int64)
        bits = np.unpackbits(self.lower, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return (high.astype(np.int64) << self.low) | bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))


def pack_file(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = known[:1]
    docs = least.astype("<i8").tobytes() + ef_encode((known - least).astype(np.uint64) if len(known) else known)
    bounds = ef_encode(np.concatenate([[0], np.cumsum([len(x) for x in ids])]))
    body = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    head = np.array([len(doc_ids), len(body), width, nulls, len(docs), len(bounds)], "<u8").tobytes()
    return MAGIC + head + docs + bounds + body.astype(f"<u{width}").tobytes()


class TokenFile:
    """A file's documents: ids(i) are those of its i-th."""

    def __init__(self, data: bytes | memoryview) -> None:
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.n, self.n_ids, self.width, nulls, a, b = (int(x) for x in np.frombuffer(data[8:56], "<u8"))
        block = data[56 : 56 + a]
        known = []
        if nulls < self.n:
            known = (EliasFano(block[8:]).all() + int(np.frombuffer(block[:8], "<i8")[0])).tolist()
        self.doc_ids: list[int | None] = [None] * nulls + known
        self.bounds = EliasFano(data[56 + a : 56 + a + b])
        self.body = np.frombuffer(data[56 + a + b :], f"<u{self.width}")

    def ids(self, i: int) -> np.ndarray:
        return self.body[self.bounds.select(i) : self.bounds.select(i + 1)]


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes under another name and then renames, so that a task that dies leaves no half file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/_{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    if store.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
        store.delete_file(f"{path}/{name}")
    store.move(draft, f"{path}/{name}")


def _writer(folder: str, path: str, end: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        size, made = 0, []
        code = encoder(path)
        width = 2 if max(code.tokenizer.get_vocab_size(), end + 1) <= 65536 else 4
        tail = np.array([end], "<u4")

        def flush() -> None:
            nonlocal docs, ids, size
            if docs:
                name = f"part-{part:06d}-{len(made):06d}.eft"
                _put(folder, name, pack_file(docs, ids, width))
                made.append((name, len(docs), size))
            docs, ids, size = [], [], 0

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for piece in portions(texts):
                for key, x in zip(keys[piece], code.batch(texts[piece]), strict=True):
                    x = np.concatenate([x, tail]).astype(f"<u{width}")
                    docs.append(key)
                    ids.append(x)
                    size += len(x)
                    if size >= most:
                        flush()
        flush()
        yield pa.RecordBatch.from_pydict({"file": [x[0] for x in made], "n_docs": [x[1] for x in made], "n_ids": [x[2] for x in made]}, schema=pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = 2, ids_per_file: int = 2_000_000) -> DataFrame:
    """Writes docs (doc_id, text; more columns are ignored) as token files, in ascending doc_id order over all files.

    Returns (file, n_docs, n_ids, first_id): one row a file, first_id the ids in the files before it. A null text is an
    empty one: the end id alone. Null doc_ids come first, repeated ones stand next to each other. No documents: no rows.
    Documents are dealt by ranges of doc_id; a task holds one file at a time, and a task that is run again writes the
    same files again. One document is never split, so its ids have to fit in a task.
    """
    key = F.col("doc_id").asc_nulls_first()
    dealt = docs.select("doc_id", "text").repartitionByRange(key).sortWithinPartitions(key)
    made = written(dealt.mapInArrow(_writer(folder, tokenizer or vocabulary(), end, ids_per_file), "file string, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file of 2 million ids
    return made.select("file", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("first_id"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            file = TokenFile(content.as_buffer())
            bounds = file.bounds.selects(0, file.n + 1).tolist()
            crc = [zlib.crc32(file.body[i:j].astype("<u4").tobytes()) for i, j in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name.as_py()] * file.n, pa.string()), pa.array(file.doc_ids, pa.int64()), pa.array(bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())],
                ["file", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files that write_token_files() listed."""
    spark = files.sparkSession
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.eft").load(folder)
    rows = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(_read, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(files.select("file", "first_id"), "file").select("doc_id", (F.col("first_id") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """Writes docs as token files in the shared folder, reads them back and describes every document."""
    spark = docs.sparkSession
    folder = scratch(spark, "eft")
    files = write_token_files(docs, folder, tokenizer, end)
    if not files.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(files, folder)
