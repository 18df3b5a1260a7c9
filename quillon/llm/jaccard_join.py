"""N-gram Jaccard join by parity sketches (operator 5).

Sets with a Jaccard similarity of 0.8 or more differ in at most (|A| + |B|) / 9
elements, D. Each set is cut into blocks by ranges of its elements' hashes, the number of blocks
set by its size band (a power of two); the XOR of a block's hashes is the block's
parity sketch. A difference touches one block, so at most D of a set's non-empty blocks are lacking in the other:
whatever order all blocks are put in, sets that share no sketch among the first D + 1 of their
non-empty blocks can't link. Sets with too few non-empty blocks also send their
first D + 1 elements, which finds the pairs among them. Sets near the lower end of a band
take part in the band below too.

Documents with equal words are one class. In a bucket (sketches that are equal) each member is paired
with one pivot only, first inside a map task, then between tasks; for the first
verification the pivot is the bucket's most central member. After that only pairs in different components of
what has linked so far are of interest, in buckets that still hold several components. Where such a bucket is
crowded, as those of a passage that many documents share, crowded sketches go to the end of the common order:
only the sketches that come into a document's first D + 1 for them are sent, and of the others those
that meet one of these. Documents that hold too little else, or meet in crowded buckets again, take part once more
with their blocks in the order of their frequency among them, the rarest first: what many hold is then
beyond the first D + 1 of all documents that hold much else. Pairs are dropped if a
1024-bit parity sketch of the whole sets, or a wider one of large sets, shows too large a difference;
the rest are verified on the texts, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import boxed, components, materialize, shuffle_width, table
from quillon.llm.shingles import KNOWN_WORDS, SKETCH_BITS, difference, mix, overlap, shingles, sketch, words_of
from quillon.llm.url_filter import bloom_words, may_hold

#: Elements of a block in a set at the upper end of its band.
PER_BLOCK = 3.4
#: Emitted sketches that a map task combines at a time.
CHUNK = 1_000_000
#: A bucket with more members outside its largest component is crowded; as many comparisons of sketches cost about what it takes to send a document again.
CROWD = 64
WORDS = SKETCH_BITS // 64
#: Both hashes of a key for a filter; keys are hashes themselves, and the places that a filter takes from each overlap little.
SPREAD = ("key", "shiftrightunsigned(key, 34) | shiftleft(key, 30)")


def spread(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``SPREAD`` of an array of keys."""
    return keys, (keys >> np.uint64(34)) | (keys << np.uint64(30))


def block_keys(s: np.ndarray, band: int, most: int) -> list[tuple[int, int, np.ndarray]]:
    """(scheme, ``most``, keys) of the non-empty blocks of the sorted set ``s`` in the scheme of ``band``, and of its elements if those are too few."""
    blocks = max(2, int(np.ceil((2 << band) / PER_BLOCK)))
    at = ((s >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    xor = np.bitwise_xor.reduceat(s, first)
    found = [(2 * band, most, mix(xor ^ mix(at[first] + np.uint64(band << 40))))]
    if len(first) <= most:
        found.append((2 * band + 1, most, mix(s ^ np.uint64(0xF1357AEA2E62A9C5 ^ band))))
    return found


def schemes(s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(scheme, most, keys): in each scheme sets that link share one of the first ``most`` + 1 keys, in any common order.

    Those of at most three elements link with equal sets only and have one key.
    """
    n = len(s)
    if n < 4:
        return [(0, 0, mix(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA24BAED4963EE407)), keepdims=True) + np.uint64(n)))] if n else []
    band = n.bit_length() - 1
    found = block_keys(s, band, (n + n * 5 // 4) // 9)
    below = (1 << band) - 1
    if 5 * below >= 4 * n:  # a partner can be in the band below
        found += block_keys(s, band - 1, (below + n) // 9)
    return found


def emitted(s: np.ndarray) -> np.ndarray:
    """The keys of a set, of each scheme the first in the order of blocks."""
    return np.concatenate([np.empty(0, dtype=np.uint64), *(keys[: most + 1] for _, most, keys in schemes(s))])


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *(x.view(np.int64) for x in rows)])))


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, digest, sk, wide, keys = [], [], [], [], []
        for t in b.column(1):
            words = words_of(t.as_py() or "")
            s = shingles(words)
            n.append(len(s))
            digest.append(sha256(b" ".join(words)).digest())
            keys.append(emitted(s))
            sk.append(sketch(s))
            wide.append(sketch(s, 1 << (2 * len(s) - 1).bit_length()).tobytes() if len(s) > SKETCH_BITS // 2 else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists(sk), pa.array(wide, pa.binary()), lists(keys)], ["doc_id", "n", "digest", "sketch", "wide", "keys"])


def combine(keys: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
    """(key, x, p) of a chunk: p is the smallest id of the key in it."""
    if not keys:
        return
    key, x = np.concatenate(keys).view(np.int64), np.repeat(np.array(ids, dtype=np.int64), [len(k) for k in keys])
    order = np.lexsort((x, key))
    key, x = key[order], x[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    p = x[np.flatnonzero(first)][np.cumsum(first) - 1]
    keep = first | (x != p)
    key, x, p = key[keep], x[keep], p[keep]
    for i in range(0, len(key), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 100_000]) for v in (key, x, p)], ["key", "x", "p"])


def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The combined keys of rows (doc_id, digest, keys), of equal words in a chunk once."""
    keys, ids, total, seen = [], [], 0, set()
    for b in batches:
        flat, ends = b.column(2).flatten().to_numpy().view(np.uint64), np.cumsum(b.column(2).value_lengths().to_numpy())
        for doc_id, kind, got in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), np.split(flat, ends[:-1]), strict=True):
            if kind in seen:
                continue
            seen.add(kind)
            keys.append(got)
            ids.append(doc_id)
            total += len(got)
            if total >= CHUNK:
                yield from combine(keys, ids)
                keys, ids, total, seen = [], [], 0, set()
    yield from combine(keys, ids)


def emit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, scheme, most, total, key) of all keys of each scheme."""
    for b in batches:
        for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for scheme, most, keys in schemes(shingles(words_of(t.as_py() or ""))):
                same = lambda v, n=len(keys), kind=pa.int64(): pa.array(np.full(n, v), kind)
                yield pa.RecordBatch.from_arrays([same(doc_id), same(scheme), same(most), same(len(keys)), pa.array(keys.view(np.int64))], ["x", "scheme", "most", "total", "key"])


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and id: members with their pivot, and pivots of several chunks with the first of them."""
    last_key = last_id = None
    for b in batches:
        key, x, p = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        inner = x != p
        out = [np.stack((key[inner], x[inner], p[inner]))]
        key, x = key[~inner], x[~inner]
        if len(key):
            new = np.concatenate(([key[0] != last_key], key[1:] != key[:-1]))
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            pivot = np.where(head >= 0, x[head], last_id if last_id is not None else 0)
            other = x != pivot
            out.append(np.stack((key[other], x[other], pivot[other])))
            last_key, last_id = key[-1], pivot[-1]
        got = np.concatenate(out, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in got], ["key", "x", "p"])


def central_pairs(stars: DataFrame) -> DataFrame:
    """(x, p, c): each member with the most central one of its buckets, and how many buckets say so.

    A document's weight is the sum of its buckets' sizes: those in the middle of a group of near
    copies share the most, and most of the group links with them.
    """
    sizes = stars.groupBy("key").agg((F.count(F.lit(1)) + 1).alias("size"), F.min("p").alias("first"))
    members = stars.select("key", "x").union(sizes.select("key", "first"))
    weight = members.join(sizes.select("key", "size"), "key").groupBy("x").agg(F.sum("size").alias("w"))
    pivots = members.join(weight, "x").groupBy("key").agg(F.max(F.struct("w", -F.col("x"))).alias("top")).select("key", (-F.col("top")["col2"]).alias("p"))
    return members.join(pivots, "key").where("x <> p").groupBy("x", "p").agg(F.count(F.lit(1)).alias("c"))


def close_enough(a: str, b: str) -> Column:
    """Whether sizes and whole-set sketches of the rows aliased ``a`` and ``b`` leave a link possible."""
    differ = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(WORDS)), F.lit(0))
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (na * 5 >= nb * 4) & (nb * 5 >= na * 4) & (differ * 9 <= na + nb)


def sifted(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """``pairs(a, b)`` without those of two large sets whose wide sketches, two bits an element and more, differ too much."""
    side = lambda k: wide.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"w{k}"))
    both = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "na", "nb", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = list(zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), b.column("wa"), b.column("wb"), strict=True))
            words = lambda x: np.frombuffer(x.as_buffer(), dtype=np.int64)
            yield b.filter(pa.array([x is None or y is None or 9 * difference(words(u), words(v)) <= x + y for x, y, u, v in n], pa.bool_())).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def texts_of(ids: DataFrame, docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(id, text) of the wanted ids, written; a filter of at most 8 MB spares the shuffle of most other texts."""
    words = spark.sparkContext.broadcast(bloom_words(ids.select(F.col("id").alias("key")), spark, most_bytes=8 << 20))
    at = docs.schema.names.index("text")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = may_hold(words.value, b.column(at + 1).to_numpy(), b.column(at + 2).to_numpy())
            yield b.filter(pa.array(ok)).select([0, at])

    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h1"), F.xxhash64("doc_id", F.lit(1)).alias("h2"))
    found = hashed.mapInArrow(likely, "id long, text string")
    return materialize(found.join(ids, "id", "left_semi").dropDuplicates(["id"]), spark)


def verify(pairs: DataFrame, docs: DataFrame, spark: SparkSession, percent: int = 80) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have 100 * intersection >= percent * union, by their words."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, spark)
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        coded = lru_cache(maxsize=64)(lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], dtype=np.int64))
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                if len(numbers) > KNOWN_WORDS:
                    numbers.clear()
                    coded.cache_clear()
                s, t, same = overlap(coded(x.as_py()), coded(y.as_py()))
                ok.append(100 * same >= percent * (s + t - same))
            yield b.filter(pa.array(ok, pa.bool_())).select([0, 1])

    return materialize(both.mapInArrow(run, "a long, b long"), spark)


def replaced_keys(crowded: DataFrame, texts: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(key, id) and (id): with the ``crowded(key)`` last in the order of keys, what can still make the documents ``texts(id, text)`` meet in
    other buckets than before, and those that can also meet in crowded ones.

    The order is by a filter of at most 8 MB over the crowded keys, the same for all documents, so keys that it
    holds by mistake are only late. Documents that share a key among their first ones in this order share one that came into the first ones
    of either for a crowded key, or one of the filter (then both have too few others), or met in a bucket that isn't crowded.
    """
    late = spark.sparkContext.broadcast(bloom_words(crowded, spark, most_bytes=8 << 20, hashes=SPREAD))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, came, short, none = [], [], [], np.empty(0, dtype=np.uint64)
            for t in b.column(1):
                old, new, few = [], [], False
                for _, most, keys in schemes(shingles(words_of(t.as_py() or ""))):
                    hit = may_hold(late.value, *spread(keys))
                    at = np.flatnonzero(~hit)
                    few |= len(at) <= most and bool(hit.any())
                    at = at[: most + 1]
                    old.append(keys[at[at <= most]])
                    new.append(keys[at[at > most]])
                before.append(np.concatenate([none, *old]))
                came.append(np.concatenate([none, *new]))
                short.append(few)
            yield pa.RecordBatch.from_arrays([b.column(0), lists(before), lists(came), pa.array(short, pa.bool_())], ["id", "before", "came", "short"])

    parts = materialize(texts.mapInArrow(split, "id long, before array<long>, came array<long>, short boolean"), spark)
    came = parts.select(F.explode("came").alias("key"), "id")
    wanted = spark.sparkContext.broadcast(bloom_words(came.select("key").distinct(), spark, most_bytes=8 << 20, hashes=SPREAD))

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ids = b.column(1).flatten(), np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy())
            ok = may_hold(wanted.value, *spread(flat.to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([flat.filter(pa.array(ok)), pa.array(ids[ok])], ["key", "id"])

    return came.union(parts.select("id", "before").mapInArrow(meeting, "key long, id long")), parts.where("short").select("id")


def rarest_first(ids: DataFrame, docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(key, id): of the documents ``ids(id)`` the first keys of each scheme, the rarest among these documents first.

    Keys that one document alone has come before all others and meet nothing, so they only count.
    """
    rows = materialize(texts_of(ids, docs, spark).mapInArrow(emit_all, "x long, scheme long, most long, total long, key long"), spark)
    met = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), spark)
    held = rows.join(met, "key").groupBy("x", "scheme").agg(F.first("most").alias("most"), F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("c", "key"))).alias("keys"))  # as long as one text
    left = F.col("most") + 1 - F.col("total") + F.size("keys")
    return held.where(left > 0).select(F.col("x").alias("id"), F.explode(F.slice("keys", F.lit(1), left.cast("int"))).alias("k")).select("k.key", "id")


def with_major(held: DataFrame) -> DataFrame:
    """``held(key, id, part)`` with each key's largest component and the number of members outside it."""
    sizes = held.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"))
    of_key = sizes.groupBy("key").agg(F.max(F.struct("c", "part")).alias("top"), F.sum("c").alias("c"))
    return held.join(of_key.select("key", F.col("top.part").alias("major"), (F.col("c") - F.col("top.c")).alias("outside")).where("outside > 0"), "key")


def pairs_of(held: DataFrame, described: DataFrame, spark: SparkSession) -> DataFrame:
    """Likely pairs (a, b) of the members (key, id, part, major) of buckets; of two rows outside the largest component one is enough."""
    held = materialize(held.select("key", "id", "part", "major").join(described, F.col("id") == F.col("doc_id")).drop("doc_id"), spark)
    apart = (F.col("a.part") != F.col("b.part")) & ((F.col("b.part") == F.col("b.major")) | (F.col("a.id") > F.col("b.id")))
    met = held.where("part <> major").alias("a").join(held.alias("b"), (F.col("a.key") == F.col("b.key")) & apart & close_enough("a", "b"))
    return met.select(F.greatest("a.id", "b.id").alias("a"), F.least("a.id", "b.id").alias("b")).distinct()


def jaccard_components(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Documents without words have an empty set and link with nothing, not with each other. Equal sets
    link whatever their texts. Rows that repeat both id and words are one document; rows that repeat an id with other words are
    documents of their own, linked by the id that they share, in whatever order the rows come. A row with a null id keeps its n_shingles, links with nothing and has
    a null component_id. Other columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = materialize(docs.mapInArrow(describe, "doc_id long, n long, digest binary, sketch array<long>, wide binary, keys array<long>"), spark)
    known = docs.where("doc_id IS NOT NULL")
    sets = feats.where("doc_id IS NOT NULL AND n > 0")
    shared_ids = materialize(sets.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id"), spark)
    if not shared_ids.isEmpty():
        return _with_own_ids(docs, shared_ids, spark)
    # equal words make equal sets; sets that are equal for other words meet in the buckets
    lowest = materialize(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1"), spark)
    copies = sets.select("doc_id", "digest").join(lowest, "digest")
    copies = materialize(copies.where("doc_id <> rep").select("doc_id", "rep").distinct(), spark)

    rows = sets.select("doc_id", "digest", "keys").mapInArrow(emit, "key long, x long, p long")
    # members of a chunk's bucket are dealt by id as well: only one pivot a chunk meets the others of its key
    rows = rows.repartition(shuffle_width(spark), "key", F.when(F.col("x") == F.col("p"), F.lit(0)).otherwise(F.col("x")))
    stars = materialize(rows.sortWithinPartitions("key", "x").mapInArrow(shared, "key long, x long, p long"), spark)

    def replaced(df: DataFrame, to: DataFrame, name: str, out: str) -> DataFrame:
        """``df`` with ``out``: what ``to(was, now)`` has for the id in ``name``, or the id."""
        return df.join(to.select(F.col("was").alias(name), "now"), name, "left").withColumn(out, F.coalesce("now", name)).drop("now")

    first_copy = copies.select(F.col("doc_id").alias("was"), F.col("rep").alias("now"))
    rep_of = lambda df, name: replaced(df, first_copy, name, name)
    described = sets.select("doc_id", "n", "sketch").dropDuplicates(["doc_id"])
    met = stars.groupBy("x", "p").agg(F.count(F.lit(1)).alias("c")).withColumns({"x0": F.col("x"), "p0": F.col("p")})
    met = materialize(rep_of(rep_of(met, "x"), "p").where("x <> p"), spark)
    pairs = rep_of(rep_of(central_pairs(stars), "x"), "p").where("x <> p")
    pairs = pairs.groupBy("x", "p").agg(F.sum("c").alias("c")).alias("m").join(described.alias("a"), F.col("m.x") == F.col("a.doc_id")).join(described.alias("b"), F.col("m.p") == F.col("b.doc_id"))
    likely = pairs.where(close_enough("a", "b")).select("x", "p", "c")
    best = likely.groupBy("x").agg(F.max(F.struct("c", -F.col("p"))).alias("best")).select(F.col("x").alias("a"), (-F.col("best")["col2"]).alias("b"))
    large = sets.where("wide IS NOT NULL").select("doc_id", "n", "wide").dropDuplicates(["doc_id"])
    tried = materialize(sifted(best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), large), spark)
    links = verify(tried, known, spark)
    parts = materialize(components(links, spark), spark)

    def part_of(df: DataFrame, name: str, out: str, parts: DataFrame = parts) -> DataFrame:
        return replaced(df, parts.select(F.col("id").alias("was"), F.col("component").alias("now")), name, out)

    # buckets with an edge between components, and what they hold
    crossing = part_of(part_of(met, "x", "cx"), "p", "cp").where("cx <> cp").select(F.col("x0").alias("x"), F.col("p0").alias("p")).distinct()
    mixed = stars.join(crossing, ["x", "p"], "left_semi").select("key").distinct()
    held = stars.join(mixed, "key", "left_semi").select("key", F.explode(F.array("x", "p")).alias("id")).distinct()
    held = materialize(part_of(rep_of(held, "id"), "id", "part").distinct(), spark)
    held = materialize(with_major(held), spark)
    more = pairs_of(held.where(F.col("outside") <= CROWD), described, spark)
    crowded = held.where(F.col("outside") > CROWD)
    if not crowded.isEmpty():
        texts = texts_of(crowded.select("id").distinct(), known, spark)
        moved, short = replaced_keys(crowded.select("key").distinct(), texts, spark)
        moved = materialize(with_major(materialize(part_of(moved, "id", "part").distinct(), spark)), spark)
        more = more.union(pairs_of(moved.where(F.col("outside") <= CROWD), described, spark))
        left = moved.where(F.col("outside") > CROWD).select("id").union(short).distinct()
        again = part_of(rarest_first(left, texts.withColumnRenamed("id", "doc_id"), spark), "id", "part")
        more = more.union(pairs_of(with_major(materialize(again, spark)), described, spark))
    more = materialize(sifted(materialize(more.distinct(), spark), large), spark)
    links = links.union(verify(more.join(tried, ["a", "b"], "left_anti"), known, spark))
    parts = materialize(components(links, spark), spark)

    out = feats.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("id"))
    return part_of(rep_of(out, "id"), "id", "component_id", parts).select("doc_id", "n_shingles", "component_id")


def _with_own_ids(docs: DataFrame, shared_ids: DataFrame, spark: SparkSession) -> DataFrame:
    """``jaccard_components`` where ``shared_ids(doc_id)`` have several texts: each of these texts gets an id that no row has, and at the
    end the components that an id has a part in become one."""
    keyed = docs.withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    texts = keyed.where("h IS NOT NULL").join(shared_ids, "doc_id", "left_semi").select("doc_id", "h").distinct()
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    own = materialize(texts.withColumn("own", F.lit(low) - 1 - number if low > -(1 << 62) else F.lit(high) + 1 + number), spark)
    renamed = keyed.join(own, ["doc_id", "h"], "left").select(F.coalesce("own", "doc_id").alias("doc_id"), "text")
    found = jaccard_components(renamed, spark)
    was = own.select("own", F.col("doc_id").alias("was"))
    for c in ("doc_id", "component_id"):
        found = found.join(was, F.col(c) == F.col("own"), "left").withColumn(c, F.coalesce("was", c)).drop("own", "was")
    found = materialize(found, spark)
    parts = components(found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), spark)
    return found.join(parts.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps its smallest id.

    Rows with a null id and texts that are null or without words always stay; rows that repeat an id
    stay or go together. Columns may have any other names; an empty table gives an empty result.
    """
    gone = jaccard_components(docs, spark).where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    return boxed(docs, id=F.col("doc_id").cast("long")).join(gone, "id", "left_anti").select("row.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), spark)
