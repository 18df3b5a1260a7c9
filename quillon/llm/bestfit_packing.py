"""Packing whole documents into few sequences: Martello-Toth dominance reduction, then best fit (operator 12).

Pieces of equal length are interchangeable, so the instance is a histogram of at most ``capacity`` lengths however many
documents there are. Tokenizing tasks number the pieces of each length that they meet; the histogram goes to the
driver, which fixes dominating sets and best-fits the rest there, many equal sequences at a time. The plan says which numbers
of a length go where; counts of the tasks before turn a task's numbers into numbers over all tasks, and each
piece looks its place up. No step sorts all pieces, and no two pieces have to meet.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table
from quillon.llm.packing import encoder

CAPACITY = 1024
#: Id that ends each document.
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, number long"
#: (lengths of a sequence in falling order with their counts, how many such sequences)
Pattern = tuple[tuple[tuple[int, int], ...], int]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """PIECES of all documents: ``number`` counts the pieces of this length in ``task``; with ``keep_ids`` also their ids.

    A document longer than ``capacity`` is cut from its end into pieces of that length, so the first may be shorter.
    """
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode, seen, rows = TaskContext.get().partitionId(), encoder(), Counter(), []
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *[pa.list_(pa.int32())] * keep_ids]

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                start = 0
                for k, end in enumerate(ends):
                    part = ids[start:end]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)], *([part.astype(np.int32)] if keep_ids else [])))
                    seen[len(part)] += 1
                    start = end
                if len(rows) >= 20_000 or keep_ids and len(rows) >= 500:
                    yield batch()
        yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Instance:
    """A multiset of lengths, with the questions that dominance asks of it."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.capacity = capacity
        self.lengths = sorted(self.counts)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for n in lengths:
            self.counts[n] -= times
        gone = {n for n in lengths if not self.counts[n]}
        if gone:
            self.lengths = [n for n in self.lengths if n not in gone]
            for n in gone:
                del self.counts[n]

    def left(self, n: int, *used: int) -> int:
        """Pieces of length ``n`` beside those in ``used``."""
        return self.counts.get(n, 0) - used.count(n)

    def largest(self, room: int, *used: int) -> int:
        """The longest piece that fits into ``room`` beside those in ``used``; 0 if none does."""
        at = int(np.searchsorted(self.lengths, room, side="right")) - 1
        while at >= 0 and self.left(self.lengths[at], *used) <= 0:
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def fills_better(self, room: int, than: int, *used: int) -> bool:
        """Whether some pieces beside those in ``used`` sum up to more than ``than`` and at most ``room``: subset sums in one bit set."""
        reach, mask = 1, (1 << (room + 1)) - 1
        for n in self.lengths:
            if n > room:
                break
            many, k = min(self.left(n, *used), room // n), 1
            while many > 0:  # the count in binary parts
                k = min(k, many)
                reach |= (reach << (n * k)) & mask
                many, k = many - k, 2 * k
            if reach >> (than + 1):
                return True
        return False

    def dominating(self, n: int) -> tuple[int, ...] | None:
        """At most two pieces that with one of length ``n`` dominate every other sequence it can lie in; None if there are none.

        A set dominates another if the other's pieces can be dealt out to the set's so that none is overfilled: then they can
        change places without a further sequence. One piece dominates if no set that fits is longer than it. Two do, the
        longest that fits and the longest that fits beside it, if no three fit at all and no other pair has
        a shorter one above the shorter of these while both together exceed the longer of these.
        """
        room = self.capacity - n
        a = self.largest(room, n)
        if not a:
            return ()
        if a == room or not self.fills_better(room, a, n):
            return (a,)
        b = self.largest(room - a, n, a)
        if not b or self.three_fit(room, n):
            return None
        for q in self.lengths:
            if 2 * q > room:
                break
            if q > b and self.left(q, n) > 0:
                p = self.largest(room - q, n, q)
                if p >= q and p + q > a:
                    return None
        return a, b

    def three_fit(self, room: int, *used: int) -> bool:
        total, need = 0, 3
        for n in self.lengths:
            k = min(need, max(0, self.left(n, *used)))
            total, need = total + n * k, need - k
            if not need:
                return total <= room
            if total > room:
                return False
        return False


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences that some best packing holds, fixed by dominance, and the pieces that remain.

    A set that dominates goes on doing so while its pieces last, since fewer pieces make fewer alternatives; so as many
    equal sequences are fixed at once as there are pieces for. Lengths are gone through in falling order until nothing changes.
    """
    rest, fixed, changed = Instance(counts, capacity), [], True
    while changed:
        changed = False
        for n in sorted(rest.lengths, reverse=True):
            while n in rest.counts and (others := rest.dominating(n)) is not None:
                content = Counter((n, *others))
                times = min(rest.counts[k] // c for k, c in content.items())
                rest.take((n, *others), times)
                fixed.append((tuple(sorted(content.items(), reverse=True)), times))
                changed = True
    return fixed, rest.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit in falling order of length; sequences with equal content are one entry with a count."""
    opened: dict[int, list[tuple[Counter, int]]] = {}  # by the room that is left
    for n in sorted(counts, reverse=True):
        many = counts[n]
        while many:
            room = min((r for r in opened if r >= n), default=None)
            if room is None:  # a new sequence takes as many of this length as it holds
                room, each = capacity, min(many, capacity // n)
                content, have = Counter(), many // each
            else:
                content, have = opened[room].pop()
                each = min(many, room // n)
                if not opened[room]:
                    del opened[room]
            times = min(have, many // each)
            if have > times:
                if room < capacity:
                    opened.setdefault(room, []).append((content, have - times))
            opened.setdefault(room - each * n, []).append((content + Counter({n: each}), times))
            many -= each * times
    return [(tuple(sorted(content.items(), reverse=True)), times) for groups in opened.values() for content, times in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: Martello and Toth's L2."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for cut in {0} | {n for n in counts if 2 * n <= capacity}:
        long = {n: c for n, c in counts.items() if n > capacity - cut}
        half = {n: c for n, c in counts.items() if capacity - cut >= n and 2 * n > capacity}
        small = sum(n * c for n, c in counts.items() if cut <= n and 2 * n <= capacity)
        spare = sum((capacity - n) * c for n, c in half.items())
        best = max(best, sum(long.values()) + sum(half.values()) + max(0, -(-(small - spare) // capacity)))
    return best


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Sequences that hold each piece of the histogram once."""
    fixed, rest = reduced(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length rows (first number, first sequence, pieces a sequence, offset of the first) in the order of the numbers."""
    found, used, sequence = {}, Counter(), 0
    for content, times in patterns:
        offset = 0
        for n, each in content:
            found.setdefault(n, []).append((used[n], sequence, each, offset))
            used[n] += each * times
            offset += n * each
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in found.items()}


def pack(docs: DataFrame, spark: SparkSession, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, with ``keep_ids`` also its ids.

    Null text counts as empty; every document ends in ``end_id``, so the empty ones are a piece of length 1. Only documents longer
    than ``capacity`` are cut. Rows that repeat a doc_id are packed each on its own; a null doc_id stays null. An empty table
    gives an empty result; other columns are not read. The driver holds a count for each length (at most
    ``capacity``) and the plan made of them, which doesn't grow with the documents.
    """
    cut = materialize(pieces(docs, capacity, end_id, keep_ids), spark)
    # a count for each task and length; those of the tasks before make a task's numbers unique
    by_task = materialize(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), spark)
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = places(planned(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kept = [c for c in cut.columns if c not in ("task", "number")]
    numbered = cut.join(base, ["task", "length"]).select(*kept, (F.col("base") + F.col("number")).alias("number"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name in kept) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence, offset = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for n in np.unique(length):
                at, rows = np.flatnonzero(length == n), plan[int(n)]
                row = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1]
                within = number[at] - row[:, 0]
                sequence[at] = row[:, 1] + within // row[:, 2]
                offset[at] = row[:, 3] + within % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema)


def op12_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), spark)
