"""Removal of repeated 200-byte strings by prefix-free parsing (operator 6).

A rolling hash of 16 bytes triggers the cuts: the trigger of a 200-byte string is its
16-byte piece with the smallest hash, the leftmost of equal ones. A phrase is the run of string starts
that share one trigger, with the bytes of all their strings; neighbouring phrases overlap by 199
bytes, so every 200-byte string lies in exactly one phrase, and equal strings have equal triggers at the same
place. A text is thus a parse, a sequence of phrases, and the corpus a dictionary of distinct phrases.

Parse: a trigger met once holds no repeat. A trigger that has one phrase only, met more than
once, holds nothing else. Only where a trigger has several phrases does their content count: the
suffixes of the dictionary's phrases are ranked to a depth of 200 bytes by prefix doubling, as in
building a suffix array, and strings of equal rank are repeats. The phrases of a trigger that has more of them than
one task should hold are dealt over all tasks string by string, which are grouped by their content. Results go back from
phrases to the texts that hold them.

The parse's suffix array and its combination with the dictionary's into corpus order are left out: every string of
interest lies whole in one phrase, so the order of phrases decides nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, shuffle_width, table
from quillon.llm.shingles import mix
from quillon.llm.url_filter import bloom_words, may_hold

LENGTH = 200
TRIGGER = 16
#: String starts handled at a time; a longer text is parsed in parts, whose phrases end there.
PART = 1 << 19
#: Bytes of short texts that are parsed at a time.
TOGETHER = 1 << 16
#: Phrases of one trigger that one task compares in memory; the strings of more are dealt out. Both ways compare content.
MOST_PHRASES = 16_000
_BYTE = np.random.default_rng(20_240_229).integers(0, 1 << 64, 256, dtype=np.uint64)


def parse(b: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Phrases of the texts that stand one behind the other in the bytes ``b``, up to ``ends``: trigger, print, first and last + 1 string start in ``b``."""
    if len(b) < length:
        return (np.empty(0, dtype=np.uint64),) * 2 + (np.empty(0, dtype=np.int64),) * 2
    g = _BYTE[b]
    step = 1
    while step < TRIGGER:
        g = g[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + g[step:]
        step *= 2
    g = mix(g)
    low_bits = np.uint64((1 << 20) - 1)
    m = (g & ~low_bits) | np.arange(len(g), dtype=np.uint64)
    span, step = length - TRIGGER + 1, 1
    while 2 * step <= span:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if span > step:
        m = np.minimum(m[: len(m) - (span - step)], m[span - step :])
    at = (m & low_bits).astype(np.int64)
    # the last starts of a text, whose strings would run into the next one, have none; so no phrase is of two texts
    within = np.ones(len(at) + 2, dtype=bool)
    within[[0, -1]] = False
    for end in ends[:-1].tolist():
        within[max(1, end - length + 2) : end + 1] = False
    same = np.concatenate(([False], at[1:] == at[:-1], [False]))
    first = np.flatnonzero(within[1:-1] & ~(within[:-2] & same[:-1]))
    last = np.flatnonzero(within[1:-1] & ~(within[2:] & same[1:])) + 1
    end, whole = last + length - 1, memoryview(b)
    prints = np.fromiter((xxhash.xxh3_64_intdigest(whole[x:y], 20_240_229) for x, y in zip(first.tolist(), end.tolist(), strict=True)), dtype=np.uint64, count=len(first))
    # where the trigger stands in the phrase is part of the print
    mark = mix(prints ^ mix((end - first).astype(np.uint64) << np.uint64(20) | (at[first] - first).astype(np.uint64)))
    return g[at[first]], mark, first, last


def parsed(texts: Iterable[np.ndarray], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases of texts in their order, several short texts at a time: trigger, print, first and last + 1 string start in the text, phrases of each text."""

    def close() -> tuple[np.ndarray, ...]:
        ends = np.cumsum([len(x) for x in waiting])
        k, mark, first, last = parse(np.concatenate(waiting), ends, length)
        owner = np.searchsorted(ends, first, side="right")
        begin = (ends - [len(x) for x in waiting])[owner]
        return k, mark, first - begin, last - begin, np.bincount(owner, minlength=len(waiting))

    waiting, size = [], 0
    for raw in texts:
        if waiting and size + len(raw) > TOGETHER:
            yield close()
            waiting, size = [], 0
        if len(raw) <= TOGETHER:
            waiting.append(raw)
            size += len(raw)
            continue
        parts = []
        for low in range(0, max(1, len(raw) - length + 1), PART):
            b = raw[low : low + PART + length - 1]
            k, mark, first, last = parse(b, np.array([len(b)]), length)
            parts.append((k, mark, first + low, last + low))
        yield *(np.concatenate(x) for x in zip(*parts, strict=True)), np.array([sum(len(x[0]) for x in parts)])
    if waiting:
        yield close()


def each_parsed(texts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Trigger, print, first and last + 1 string start of the phrases of each text."""
    for *columns, n in parsed(texts):
        ends = np.cumsum(n).tolist()
        for low, high in zip([0, *ends], ends, strict=False):
            yield tuple(c[low:high] for c in columns)


def as_bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid and len(text.as_buffer()) else np.empty(0, dtype=np.uint8)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigger, print, n), equal phrases of a few texts together."""
    for b in batches:
        rows = []
        for k, mark, *_ in parsed(map(as_bytes, b.column(0))):
            _, at, n = np.unique(key_of(k, mark), return_index=True, return_counts=True)
            rows.append((k[at], mark[at], n))
        if rows:
            k, p, n = (np.concatenate(x) for x in zip(*rows, strict=True))
            for i in range(0, len(k), 200_000):
                yield pa.RecordBatch.from_arrays([longs(k[i : i + 200_000]), longs(p[i : i + 200_000]), pa.array(n[i : i + 200_000].astype(np.int64))], ["trigger", "mark", "n"])


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigger, mark, d, h): which texts hold a phrase, equal phrases of a text once, rows that a task meets again not at all."""
    seen = set()
    for b in batches:
        parts, ids = [(np.empty(0, dtype=np.uint64),) * 2 + (np.empty(0, dtype=np.int64),)], []
        for i, x in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if x not in seen:
                seen.add(x)
                ids.append(i)
        low = 0
        for k, mark, _, _, n in parsed(as_bytes(b.column(2)[i]) for i in ids):
            owner, key = np.repeat(np.arange(low, low + len(n)), n), key_of(k, mark)
            low += len(n)
            order = np.lexsort((key, owner))
            o, x = owner[order], key[order]
            at = order[np.concatenate(([True], (o[1:] != o[:-1]) | (x[1:] != x[:-1])))] if len(order) else order
            parts.append((k[at], mark[at], owner[at]))
        k, m, owner = (np.concatenate([p[j] for p in parts]) for j in range(3))
        row = np.array(ids, dtype=np.int64)[owner]
        d, h = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
        for i in range(0, len(k), 200_000):
            yield pa.RecordBatch.from_arrays([longs(k[i : i + 200_000]), longs(m[i : i + 200_000]), pa.array(d[i : i + 200_000]), pa.array(h[i : i + 200_000])], ["trigger", "mark", "d", "h"])


def chosen(phrases: tuple[np.ndarray, ...], wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a text's phrases those whose trigger is wanted, one of each print: trigger, print, start and end, and how often it occurs."""
    at = np.minimum(np.searchsorted(wanted, phrases[0]), len(wanted) - 1)
    k, mark, first, last = (x[wanted[at] == phrases[0]] for x in phrases)
    _, at, n = np.unique(key_of(k, mark), return_index=True, return_counts=True)
    return k[at], mark[at], first[at], last[at], n


def open_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigger, mark, n, phrase) of the phrases whose trigger has several."""
    for b in batches:
        out, phrases, size = [], [], 0
        for i, (t, copies, found) in enumerate(zip(b.column("text"), b.column("copies").to_pylist(), each_parsed(map(as_bytes, b.column("text"))), strict=True)):
            wanted = flat(b.column("many"), i)
            if not len(wanted):
                continue
            raw = t.as_buffer().to_pybytes()
            k, mark, first, last, n = chosen(found, wanted)
            out.append((k, mark, n * copies))
            got = [raw[x : y + LENGTH - 1] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            phrases += got
            size += sum(map(len, got))
            if size > 8 << 20:
                yield phrase_batch(out, phrases)
                out, phrases, size = [], [], 0
        if out:
            yield phrase_batch(out, phrases)


def phrase_batch(rows: list, phrases: list[bytes]) -> pa.RecordBatch:
    k, m, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([longs(k), longs(m), pa.array(n.astype(np.int64)), pa.array(phrases, pa.binary())], ["trigger", "mark", "n", "phrase"])


def ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def repeated_suffixes(phrases: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each of the distinct phrases, the runs [from, to) of string starts that a second place has as well.

    The suffixes are put in order by ranks of longer and longer prefixes, as a suffix array is built: a rank to a
    depth of 8 bytes, then three of them for 24 and for 72, then three that overlap for LENGTH = 200; where
    three ranks don't fit 64 bits, two at a time. Strings of different triggers differ, so triggers can share a call.
    """
    sizes = np.array([len(p) for p in phrases])
    b = np.frombuffer(b"".join(phrases) + bytes(LENGTH), dtype=np.uint8)
    rank, depth, parts = ranks(np.lib.stride_tricks.sliding_window_view(b, 8).copy().view(">u8").ravel().astype(np.uint64)), 8, 3
    if len(rank) >= 1 << 21:
        parts = 2
    width = np.uint64(63 // parts)

    def joined(at: slice | np.ndarray, shifts: list[int], n: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.uint64)
        for s in shifts:
            out = (out << width) | (rank[s : s + n] if isinstance(at, slice) else rank[at + s])
        return ranks(out)

    while parts * depth <= LENGTH:
        rank, depth = joined(slice(None), [i * depth for i in range(parts)], len(rank) - (parts - 1) * depth), parts * depth
    ends = np.cumsum(sizes)
    starts = sizes - LENGTH + 1
    at = np.repeat(ends - sizes, starts) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    shifts = [*range(0, LENGTH - depth, depth), LENGTH - depth]
    kind = joined(at, shifts, len(at)).astype(np.int64)
    again = np.bincount(kind, weights=np.repeat(counts, starts))[kind] > 1.5
    out, low = [], 0
    for n in starts:
        edge = np.flatnonzero(np.diff(np.concatenate(([False], again[low : low + n], [False])).view(np.int8)))
        out.append(edge)
        low += n
    return out


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigger, mark, runs) from rows sorted by trigger; a trigger has at most MOST_PHRASES."""
    keys, marks, phrases, counts, size = [], [], [], [], 0

    def close() -> pa.RecordBatch:
        runs = repeated_suffixes(phrases, counts) if phrases else []
        return runs_batch([(k, m, r) for k, m, r in zip(keys, marks, runs, strict=True) if len(r)])

    for b in batches:
        for k, m, n, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if size > 400_000 and k != keys[-1]:
                yield close()
                keys, marks, phrases, counts, size = [], [], [], [], 0
            keys.append(k)
            marks.append(m)
            phrases.append(p)
            counts.append(n)
            size += len(p)
    yield close()


def runs_batch(rows: list) -> pa.RecordBatch:
    k, m, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(m, pa.int64()), pa.array([x.astype(np.int32) for x in s], pa.list_(pa.int32()))], ["trigger", "mark", "runs"])


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigger, mark, n, at, string) of every string of a phrase."""
    for b in batches:
        for k, m, n, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            p = p.as_py()
            got = [p[i : i + LENGTH] for i in range(len(p) - LENGTH + 1)]
            for i in range(0, len(got), 50_000):
                part = got[i : i + 50_000]
                same = lambda v, n=len(part): pa.array(np.full(n, v, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([same(k), same(m), same(n), pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part, pa.binary())], ["trigger", "mark", "n", "at", "string"])


def key_of(trigger: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return mix(trigger * np.uint64(0x9E3779B97F4A7C15) + mark)


def removed(size: int, phrases: tuple[np.ndarray, ...], whole: np.ndarray, keys: np.ndarray, bounds: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which of a text's ``size`` bytes are covered by strings that occur elsewhere.

    ``whole`` triggers (sorted) repeat all their strings; of the phrases with sorted ``keys``, number i repeats
    the starts in runs[bounds[i] : bounds[i + 1]].
    """
    step, (k, mark, first, last) = np.zeros(size + 1, dtype=np.int32), phrases
    if len(whole):
        at = np.minimum(np.searchsorted(whole, k), len(whole) - 1)
        hit = whole[at] == k
        np.add.at(step, first[hit], 1)
        np.add.at(step, last[hit] + LENGTH - 1, -1)
    if len(keys):
        key = key_of(k, mark)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        for i in np.flatnonzero(keys[at] == key):
            r = first[i] + runs[bounds[at[i]] : bounds[at[i] + 1]]
            np.add.at(step, r[0::2], 1)
            np.add.at(step, r[1::2] + LENGTH - 1, -1)
    return np.cumsum(step[:-1]) > 0


def flat(lists: pa.Array, i: int) -> np.ndarray:
    """Element ``i`` of a list array of longs as unsigned numbers."""
    x = lists[i]
    return np.sort(x.values.to_numpy(zero_copy_only=False).view(np.uint64)) if x.is_valid and len(x.values) else np.empty(0, dtype=np.uint64)


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, (t, part, found) in enumerate(zip(b.column("text"), b.column("partly"), each_parsed(map(as_bytes, b.column("text"))), strict=True)):
            raw, keys, bounds, runs = as_bytes(t), np.empty(0, dtype=np.uint64), np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int64)
            if part.is_valid and len(part.values):
                k, m, r = (part.values.field(j) for j in range(3))
                keys = key_of(k.to_numpy(zero_copy_only=False).view(np.uint64), m.to_numpy(zero_copy_only=False).view(np.uint64))
                order, n, v = np.argsort(keys), r.value_lengths().to_numpy(zero_copy_only=False), r.flatten().to_numpy(zero_copy_only=False)
                at = np.cumsum(n) - n
                runs = np.concatenate([v[at[j] : at[j] + n[j]] for j in order]).astype(np.int64)
                keys, bounds = keys[order], np.concatenate(([0], np.cumsum(n[order])))
            gone = removed(len(raw), found, flat(b.column("whole"), i), keys, bounds, runs)
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            kept = raw[~gone].tobytes()
            rows.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        n, spans, sha, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([b.column("d"), b.column("h"), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["d", "h", "n_removed", "n_spans", "kept_sha256", "kept"])


def finish_lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in finish(batches):
        yield b.select(["d", "h", "n_removed", "n_spans", "kept_sha256"])


def marked_texts(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(d, h, text, copies, whole, many) of the distinct texts that hold a repeated trigger: triggers with one phrase, phrases of the others."""
    met = docs.select("text").mapInArrow(triggers, "trigger long, mark long, n long").groupBy("trigger")
    met = met.agg(F.sum("n").alias("n"), F.min("mark").alias("a"), F.max("mark").alias("b")).where("n > 1")
    met = materialize(met.select("trigger", (F.col("a") != F.col("b")).alias("several")), spark)
    held = docs.select("d", "h", "text").mapInArrow(places, "trigger long, mark long, d long, h long").join(met, "trigger")
    whole = F.collect_list(F.when(~F.col("several"), F.col("trigger"))).alias("whole")
    many = F.collect_list(F.when(F.col("several"), F.struct("trigger", "mark"))).alias("many")
    held = materialize(held.groupBy("d", "h").agg(whole, many), spark)  # arrays as long as one text has phrases
    words = spark.sparkContext.broadcast(bloom_words(held.select(F.xxhash64("d", "h").alias("key")), spark, most_bytes=8 << 20))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = may_hold(words.value, b.column("h1").to_numpy(), b.column("h2").to_numpy())
            yield b.filter(pa.array(ok)).select(["d", "h", "text"])

    key = F.xxhash64("d", "h")
    hashed = docs.select("d", "h", "text", F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2"))
    found = hashed.mapInArrow(likely, "d long, h long, text string").groupBy("d", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return materialize(found.join(held, ["d", "h"]), spark)


def repeats_removed(docs: DataFrame, spark: SparkSession, with_kept: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary, null if nothing goes).

    Null text is empty; texts of fewer than 200 bytes lose nothing. Rows that repeat id and text
    are texts of their own that repeat each other, so both lose all; rows with a null id are handled by their text.
    An empty table gives an empty result; other columns are not read. Cut points can fall inside a
    character, so what is kept is bytes; without ``with_kept`` they stay on the executors.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64("text").alias("h"), "text")
    texts = marked_texts(docs, spark)

    opened = texts.select("text", "copies", F.transform("many", lambda x: x["trigger"]).alias("many")).where(F.size("many") > 0)
    found = opened.mapInArrow(open_phrases, "trigger long, mark long, n long, phrase binary")
    phrases = materialize(found.groupBy("trigger", "mark", "phrase").agg(F.sum("n").alias("n")), spark)
    crowded = phrases.groupBy("trigger").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > MOST_PHRASES).select("trigger")
    few = phrases.join(crowded, "trigger", "left_anti").select("trigger", "mark", "n", "phrase")
    few = few.repartition(shuffle_width(spark), "trigger").sortWithinPartitions("trigger").mapInArrow(compare, "trigger long, mark long, runs array<int>")
    dealt = phrases.join(crowded, "trigger", "left_semi").select("trigger", "mark", "n", "phrase").mapInArrow(strings, "trigger long, mark long, n long, at int, string binary")
    dealt = materialize(dealt, spark)
    again = materialize(dealt.groupBy("string").agg(F.sum("n").alias("c")).where("c > 1").select("string"), spark)
    many = dealt.join(again, "string").groupBy("trigger", "mark").agg(F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + 1))).alias("runs"))
    runs = materialize(few.union(many), spark)
    held = texts.select("d", "h", F.explode("many").alias("x")).select("x.trigger", "x.mark", "d", "h")
    partly = materialize(held.join(runs, ["trigger", "mark"]).groupBy("d", "h").agg(F.collect_list(F.struct("trigger", "mark", "runs")).alias("partly")), spark)

    joined = texts.join(partly, ["d", "h"], "left").select("d", "h", "text", "whole", "partly")
    schema = "d long, h long, n_removed long, n_spans long, kept_sha256 string"
    done = joined.mapInArrow(finish, schema + ", kept binary") if with_kept else joined.mapInArrow(finish_lean, schema)
    plain = docs.select("doc_id", "d", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    out = plain.join(done, ["d", "h"], "left")
    none = F.lit(0).cast("long")
    columns = ["doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select(*columns, *["kept"] * with_kept)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"), spark, with_kept=False)
