"""Operator 13 against plain Python over all rows, and its defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quillon.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, target, percent=10, least=20, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of each document, as the contract words it."""
    of = lambda text: [zlib.crc32(w.encode()) % buckets for w in WORD.findall((text or "").translate(LOWER))]
    s, t = (Counter(b for text in texts for b in of(text)) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for doc_id, text in docs:
        found = of(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {i: (r, k) for k, (i, r) in enumerate(((id(r), r) for r in able[: percent * len(able) // 100]), 1)}
    return [(*r, drawn[id(r)][1] if id(r) in drawn else None) for r in rows]


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert order(importance.op13_importance(spark, sf).collect()) == order(plain(docs, target))


@pytest.mark.parametrize("percent", [1, 10, 50, 100])
def test_odd_texts_and_ties(spark, docs, odd, percent):
    """Nulls, empty and long texts, rows that repeat an id with the same and with another text, and null ids."""
    extra = spark.createDataFrame([(7, "one two three " * 9), (7, "four five " * 12), (7, "four five " * 12), (None, "six seven eight " * 8), (None, "six seven eight " * 8), (None, "nine " * 30)], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(extra).repartition(7)
    target = ["Some é words, four FIVE six-seven", None, ""]
    got = importance.resample(all_docs, spark.createDataFrame([(t,) for t in target], "text string"), spark, percent=percent).collect()
    assert order(got) == order(plain([tuple(r) for r in all_docs.collect()], target, percent))


def test_columns_with_the_names_of_our_own(spark):
    rows = [(i, f"w{i % 5} " * 25, 9, 9, "r", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, weight int, row string, rank double")
    got = importance.resample(df, df.select("text", "row").limit(3), spark).collect()
    assert order(got) == order(plain([r[:2] for r in rows], [r[1] for r in rows[:3]]))


def test_empty_tables(spark, empty, docs):
    assert importance.resample(empty, docs, spark).collect() == []
    got = importance.resample(docs, empty, spark).collect()
    assert order(got) == order(plain([(r.doc_id, r.text) for r in docs.collect()], []))


def test_longer_runs(spark):
    text = "a b c a b"
    n, at = importance.featured(text, importance.Buckets(10_000), 3)
    runs = [" ".join(text.split()[i : i + k]) for k in (1, 2, 3) for i in range(6 - k)]
    assert n == 5 and sorted(at) == sorted(zlib.crc32(r.encode()) % 10_000 for r in runs)


@pytest.mark.parametrize("k", [1, 2, 17, 500, 1999, 2000])
def test_radix_selection(spark, k):
    """Exactly k rows are not above the bound, for keys over the whole range of a long and with many ties."""
    rng = random.Random(k)
    a = [rng.choice([-(2**63), -5, -5, 0, 3, 2**40, 2**63 - 1]) for _ in range(2000)]
    rows = list(zip(a, [rng.randint(-(2**63), 2**63 - 1) if rng.random() < 0.5 else 4 for _ in a], range(2000), strict=True))
    df = spark.createDataFrame(rows, "a long, b long, row long").repartition(5)
    key = ["a", "b", "row"]
    bound = importance.kth(df, key, k, spark)
    assert order(df.where(importance.not_above(key, bound)).collect()) == order(sorted(rows)[:k])
    assert [tuple(r)[:3] for r in importance.ranked(df, key, spark).orderBy("rank").collect()] == sorted(rows)
