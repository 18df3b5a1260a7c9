"""Operator 12: the plan against exhaustive search, the pieces against the tokenizer file, and edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bestfit_packing as bp


def optimum(items, capacity):
    """Fewest sequences by exhaustive search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            place(i + 1, rooms)
            rooms[k] += items[i]
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def held(patterns):
    out = Counter()
    for content, times in patterns:
        for n, each in content:
            out[n] += each * times
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(4, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_reduction_keeps_a_best_packing(case):
    capacity, items = case
    fixed, rest = bp.reduced(Counter(items), capacity)
    assert all(sum(n * k for n, k in content) <= capacity for content, _ in fixed)
    assert held(fixed) + Counter(rest) == Counter(items)
    assert sum(t for _, t in fixed) + optimum([n for n, c in rest.items() for _ in range(c)], capacity) == optimum(items, capacity)


def test_plan_over_large_counts():
    """Counts of a large corpus: every piece once, none overfull, within a thousandth of the bound, in few entries."""
    sizes = np.clip(np.random.default_rng(0).lognormal(5.5, 1, 100_000).astype(int), 1, 1024)
    counts = {int(n): int(c) * 10**6 for n, c in zip(*np.unique(sizes, return_counts=True), strict=True)}
    plan = bp.planned(counts)
    assert held(plan) == Counter(counts) and all(sum(n * k for n, k in content) <= 1024 for content, _ in plan) and len(plan) < 3000
    assert sum(t for _, t in plan) <= 1.001 * bp.lower_bound(counts, 1024)


def test_best_fit_is_that_of_single_pieces():
    """Many at a time gives the rooms that piece by piece gives."""
    rng = random.Random(3)
    for _ in range(100):
        items = sorted((rng.choice([3, 5, 5, 7, 11, 20, 33]) for _ in range(rng.randint(1, 60))), reverse=True)
        rooms = []
        for n in items:
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 50) - n)
        got = bp.best_fit(Counter(items), 50)
        assert Counter({50 - sum(n * k for n, k in c): 0 for c, _ in got}).keys() == set(rooms) and sum(t for _, t in got) == len(rooms) and held(got) == Counter(items)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, ids_of, capacity=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids, found = ids_of(text), sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(-(-len(ids) // capacity))) and [r.length for r in found[1:]] == [capacity] * (len(found) - 1)
        at = 0
        for r in found:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    counts = Counter(r.length for r in rows)
    return len(by_sequence), bp.lower_bound(counts, capacity)


def test_pieces_and_places(spark, docs, tokenizer):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    n, least = check(bp.pack(docs, spark).collect(), texts, tokenizer)
    assert least <= n <= least + 2


def test_given_table(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    n, least = check(bp.op12_bestfit_packing(spark, sf).collect(), texts, tokenizer)
    assert n <= least + 1


def test_ids_are_given_back(spark, docs, tokenizer):
    rows = bp.pack(docs.limit(30), spark, capacity=50, keep_ids=True).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by_doc[r.doc_id] = by_doc.get(r.doc_id, []) + r.ids
    assert by_doc == {r.doc_id: tokenizer(r.text) for r in docs.limit(30).collect()}


def test_repeats_nulls_and_empty_table(spark, odd, empty):
    rows = bp.pack(odd.unionByName(odd), spark).collect()
    assert Counter(r.doc_id for r in rows) == {1: 4, None: 4} and len({(r.sequence_id, r.offset) for r in rows}) == 8 and len({r.sequence_id for r in rows}) == 1
    assert bp.pack(empty, spark).collect() == []


def test_many_copies_of_one_length(spark):
    """A third of all rows share a length: their numbers come from counts, whichever tasks they are in."""
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same words here' ELSE repeat('ab ', CAST(id % 400 AS INT)) END AS text").repartition(13)
    rows = bp.pack(df, spark).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 3000
    assert len({r.sequence_id for r in rows}) <= bp.lower_bound(Counter(r.length for r in rows), 1024) + 1
