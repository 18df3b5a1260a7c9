"""Packing by minimum bin slack (operator 8).

Every map task packs the documents that it reads, so no row moves. Documents of a window's length
or more are cut into full windows; their ends and the short documents wait in a pool. The longest
waiting piece opens a window, and a subset-sum dynamic programme over the pool's
multiset of lengths, held as one bit set, finds the fill closest to the capacity;
its steps are walked back to the counts. What still lacks is cut from
the longest piece that waits, and the last window of a task is cut into powers of two,
which need no padding.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table

WINDOW = 2048
#: Id that ends each document.
END_ID = 1
#: Windows are filled while so many pieces wait, so that the programme has a choice.
POOL = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def encoder(name: str = "byte_bpe_50k"):
    """Texts to ids of the tokenizer file ``name``.json; the same vocabulary as ranks is several times faster."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": len(ranks)}
    coder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: coder.encode(text, allowed_special="all", disallowed_special=())


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest that ``capacity`` holds."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0:  # the count in binary parts
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += k
            total -= length * k
    return dict(taken)


class Packer:
    """Turns documents' ids into rows of SCHEMA; ``base`` sets apart the sequence ids of a task."""

    def __init__(self, base: int, window: int = WINDOW, pool: int = POOL):
        self.next, self.window, self.pool = base, window, pool
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.n, self.tokens, self.rows = 0, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for at in range(0, len(ids), self.window):
            piece = (doc_id, at, ids[at : at + self.window], len(ids))
            if len(piece[2]) == self.window:
                self.emit([piece])
            else:
                self.put(piece)
        while self.n > self.pool:
            self.fill()

    def put(self, piece: tuple) -> None:
        self.waiting[len(piece[2])].append(piece)
        self.n += 1
        self.tokens += len(piece[2])

    def take(self, length: int) -> tuple:
        line = self.waiting[length]
        piece = line.popleft()
        if not line:
            del self.waiting[length]
        self.n -= 1
        self.tokens -= length
        return piece

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, whole in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, self.next, offset))
            offset += len(ids)
        self.next += 1

    def cut(self, length: int, size: int) -> tuple:
        """The first ``size`` ids of a waiting piece of ``length``; the rest waits on."""
        doc_id, start, ids, whole = self.take(length)
        if size < length:
            self.put((doc_id, start + size, ids[size:], whole))
        return doc_id, start, ids[:size], whole

    def fill(self) -> None:
        first = self.take(max(self.waiting))
        pieces, left = [first], self.window - len(first[2])
        for length, k in closest_fill({n: len(q) for n, q in self.waiting.items() if n <= left}, left).items():
            pieces += [self.take(length) for _ in range(k)]
            left -= length * k
        if left and self.waiting:
            pieces.append(self.cut(max(self.waiting), left))  # none that waits is as short as what lacks
        self.emit(pieces)

    def finish(self) -> None:
        while self.tokens >= self.window:
            self.fill()
        while self.tokens:  # less than a window: powers of two
            size, pieces = 1 << (self.tokens.bit_length() - 1), []
            while size:
                length = max(self.waiting)
                pieces.append(self.cut(length, min(size, length)))
                size -= len(pieces[-1][2])
            self.emit(pieces)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, window: int = WINDOW, pool: int = POOL) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty; every document ends in one more id, so the empty ones are a piece
    of length 1. Documents may be cut anywhere; ids keep their order, and each lies in one piece. Rows that
    repeat a doc_id are packed each on its own; a null doc_id stays null. An empty table gives an
    empty result. Other columns are not read. A task holds at most ``pool`` waiting pieces and
    one batch of texts; a retried task reads the same rows and numbers its sequences alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(TaskContext.get().partitionId() << 40, window, pool), encoder()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc_id, np.array([*encode(text.as_py() or ""), END_ID], dtype=np.uint32))
                if len(packer.rows) >= 20_000:
                    yield packer.batch()
        packer.finish()
        yield packer.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
