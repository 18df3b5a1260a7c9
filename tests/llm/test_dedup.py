import hashlib
import inspect
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import embed_dedup, exact_dedup, jaccard_join, shingles, suffix_dedup, url_filter
from quillon.llm.common import components

W = re.compile(r"[^\x20\x09-\x0D]+")


def roots(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    want = {i: r for i, r in roots({x for e in edges for x in e}, edges).items()}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), spark).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: want[i] for i in touched}
    assert components(spark.createDataFrame([], "a long, b long"), spark).count() == 0


def test_exact_dedup(docs, texts, empty, odd):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    first, n = {}, {}
    for i, t in enumerate(norm):
        first.setdefault(t, i * 3 + 1)
        n[t] = n.get(t, 0) + 1
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(norm):
        r = got[i * 3 + 1]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (first[t], n[t], first[t] == r.doc_id, hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(first.values())
    assert exact_dedup.exact_dedup(empty).count() == 0
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == 4 and sorted((r.doc_id or 0, r.group_size, r.kept) for r in rows) == [(0, 1, True), (0, 1, True), (1, 2, True), (1, 2, True)]


def test_verdicts_hold_for_id_and_text(spark):
    """A copy without an id, or with the id of another text, takes nothing else along."""
    rows = [(1, "a copy"), (None, "a copy"), (None, "alone"), (2, "twice"), (3, "twice"), (3, "other text"), (None, "no ids"), (None, "no  ids")]
    kept = exact_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == [(0, "alone"), (0, "no  ids"), (0, "no ids"), (1, "a copy"), (2, "twice"), (3, "other text")]


@pytest.mark.parametrize("width", [1, 0])
def test_texts_that_share_a_digest(spark, docs, texts, width, monkeypatch):
    """With digests of one byte, or one digest for all, groups still go by the whole text."""
    want = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    monkeypatch.setattr(exact_dedup, "digest_of", lambda norm: F.unhex(F.substring(F.sha2(norm, 256), 1, 2 * width)))
    assert {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()} == want
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in want.items() if r.kept)


def shingle_set(t):
    w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_join(spark, docs, texts, empty, odd):
    sets = {i * 3 + 1: shingle_set(t) for i, t in enumerate(texts)}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 20
    want = roots(ids, links)
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(docs, spark).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in ids}
    near = jaccard_join.one_of_each(docs, spark)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == set(want.values())
    assert jaccard_join.jaccard_components(empty, spark).count() == 0
    rows = jaccard_join.jaccard_components(odd, spark).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 0, 0), (0, 1, 0), (1, 1, 1), (1, 1, 1)]


def test_block_keys_meet():
    """Sets that link share a key, whatever their sizes and differences."""
    rng = np.random.default_rng(2)
    for _ in range(1500):
        n = int(rng.choice([4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 31, 33, 64, 65, 100, 127, 129, 300]))
        union = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        n = len(union)
        out = rng.permutation(n)[: n // 5]
        k = int(rng.integers(0, len(out) + 1))
        a, b = np.delete(union, out[:k]), np.delete(union, out[k:])
        same = len(np.intersect1d(a, b))
        assert 100 * same >= 80 * n
        if min(len(a), len(b)) >= 4:
            assert len(np.intersect1d(jaccard_join.emitted(a), jaccard_join.emitted(b)))
        elif same < n:
            pytest.fail("small sets can't link unless equal")


def test_sketches_bound_the_difference():
    """At every size, folded or not, two sketches differ in at most as many bits as the sets in elements."""
    rng = np.random.default_rng(7)
    for n in (3, 40, 300, 513, 840, 1856, 5000):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n - n // 7], rng.integers(0, 1 << 64, n // 5, dtype=np.uint64))))
        m = len(np.setxor1d(a, b))
        for u, v in itertools.product((1024, 4096, 1 << 14), repeat=2):
            assert shingles.difference(shingles.sketch(a, u), shingles.sketch(b, v)) <= m
        assert shingles.difference(shingles.sketch(a, 1 << 20), shingles.sketch(b, 1 << 20)) >= 0.9 * m


def thue_morse(n):
    x = "0"
    while len(x) < n:
        x += x.translate(str.maketrans("01", "10"))
    return x


def test_words_that_a_polynomial_hash_would_mix_up(spark):
    """Complementary Thue-Morse words are different words, to the hash and to the verification."""
    a, b = (thue_morse(2048).translate(str.maketrans("01", x)) for x in ("ab", "ba"))
    rng = np.random.default_rng(8)
    tail = " ".join(f"w{i}" for i in rng.integers(0, 10**9, 8))
    df = spark.createDataFrame([(1, f"{tail} {a}"), (2, f"{tail} {b}"), (3, f"x {tail} {a}"), (4, a), (5, b)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, spark).collect()}
    want = {i: shingle_set(t) for i, t in [(r.doc_id, r.text) for r in df.collect()]}
    links = [(x, y) for x in want for y in want if x < y and 100 * len(want[x] & want[y]) >= 80 * len(want[x] | want[y])]
    assert links == [(1, 3)] and got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_exact_overlap():
    rng = np.random.default_rng(9)
    for _ in range(300):
        x, y = (rng.integers(0, 4, rng.integers(0, 12)) for _ in range(2))
        if rng.random() < 0.5:
            y = np.concatenate((x[: len(x) // 2], y))
        a, b = (shingle_set(" ".join(map(str, z))) for z in (x, y))
        assert shingles.overlap(x, y) == (len(a), len(b), len(a & b))


@pytest.mark.parametrize("crowd", [16, 0])
def test_large_sets_and_shared_passages(spark, crowd, monkeypatch):
    """Sets of over 512 shingles with links just above and just below the threshold, many of which share a passage."""
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, texts = [word() for _ in range(120)], []
    for size in (700, 700, 1500, 3000, 300, 12):
        base = [word() for _ in range(size)]
        texts.append(passage[: size // 4] + base)
        for share in (0.005, 0.015, 0.02, 0.022, 0.025, 0.03, 0.04) * (3 if size < 1000 else 1):
            near = list(base)
            for i in rng.sample(range(size), max(1, round(share * size))):
                near[i] = word()
            texts.append(passage[: size // 4] + near)
    texts += [passage[:k] + [word() for _ in range(900)] for k in range(60, 120)]
    sets = {i: shingle_set(" ".join(t)) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, spark).collect()}
    assert len(links) > 50 and got == roots(sets, links)


@pytest.mark.parametrize("crowd", [16, 0])
def test_a_line_that_many_documents_share(spark, crowd, monkeypatch):
    """Crowded buckets are told apart by the few keys that take their place; few documents send all of their keys again, and no link is lost."""
    sent = []
    rarest_first = jaccard_join.rarest_first
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "rarest_first", lambda ids, *more: sent.append(ids.count()) or rarest_first(ids, *more))
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line, texts = [word() for _ in range(25)], []
    for _ in range(150):
        base = [word() for _ in range(rng.randint(240, 400))]
        texts.append(line + base)
        for share in (0.012, 0.02, 0.03):
            if rng.random() < 0.3:
                texts.append(line + [word() if rng.random() < share else w for w in base])
    sets = {i: shingle_set(" ".join(t)) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, spark).collect()}
    assert len(links) > 50 and got == roots(sets, links)
    assert not crowd or sum(sent) <= len(texts) // 3, (sent, len(texts))


def test_filter_of_keys(spark):
    """The filter is made with one row a key, holds them all and hardly any other; numpy's hashes of a key are Spark's."""
    keys = np.random.default_rng(18).integers(0, 1 << 64, 6000, dtype=np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys[:3000].view(np.int64)], "key long").cache()
    words = url_filter.bloom_words(df, spark, hashes=jaccard_join.SPREAD)
    hit = url_filter.may_hold(words, *jaccard_join.spread(keys))
    assert hit[:3000].all() and hit[3000:].mean() < 0.02
    assert "explode" not in inspect.getsource(url_filter.bloom_words)


def brute_removed(raws, length):
    where = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            where[r[i : i + length]] = where.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if where[r[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("most", [suffix_dedup.MOST_PHRASES, 2])
def test_suffix_dedup(spark, docs, texts, empty, odd, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_PHRASES", most)
    raws = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in suffix_dedup.repeats_removed(docs, spark).collect()}
    assert len(got) == len(texts)
    for i, (raw, gone) in enumerate(zip(raws, brute_removed(raws, 200), strict=True)):
        r, kept = got[i * 3 + 1], np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert r.kept is None or bytes(r.kept) == kept
    if most > 2:
        assert suffix_dedup.repeats_removed(empty, spark).count() == 0
        long = odd.selectExpr("doc_id", "repeat(text, 30) AS text")
        rows = suffix_dedup.repeats_removed(long, spark).collect()
        assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (0, 0), (1, 420), (1, 420)]


def test_repeated_rows_beside_a_shared_trigger(spark):
    """Rows that repeat id and text repeat each other also where another text shares a trigger in other surroundings."""
    rng = random.Random(13)
    base = "".join(rng.choice("abcdefghijklmnop") for _ in range(230))
    rows = [(1, base), (1, base), (None, base[5:225]), (None, base[5:225]), (2, "x" + base[:120] + "y" * 120), (3, "z" * 90 + base[100:])]
    rows += [(k, base[:200] + "".join(rng.choice("ab") for _ in range(30))) for k in range(4, 9)]
    got = suffix_dedup.repeats_removed(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()
    want = [(i or 0, int(gone.sum())) for (i, _), gone in zip(rows, brute_removed([t.encode() for _, t in rows], 200), strict=True)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == sorted(want)


def test_parse_parts(monkeypatch):
    """A text parsed in parts has each string in one phrase."""
    raw = np.frombuffer(np.random.default_rng(3).bytes(5000), dtype=np.uint8)
    for part in (1 << 19, 700):
        monkeypatch.setattr(suffix_dedup, "PART", part)
        monkeypatch.setattr(suffix_dedup, "TOGETHER", part)
        seen = np.zeros(5000 - 199, dtype=int)
        for _, _, first, last in suffix_dedup.each_parsed([raw]):
            for a, b in zip(first, last, strict=True):
                seen[a:b] += 1
        assert (seen == 1).all()


@pytest.mark.parametrize("together", [0, 700, 1 << 16])
def test_texts_parsed_together(monkeypatch, together):
    """Texts have the same phrases whether they are parsed alone or with others, and none reaches into the next text."""
    rng = np.random.default_rng(5)
    texts = [np.frombuffer(x, dtype=np.uint8) for x in (b"", b"ab", bytes(199), bytes(200), b"q" * 600, rng.bytes(200), rng.bytes(201), rng.bytes(1000), b"", rng.integers(97, 99, 2000, dtype=np.uint8).tobytes(), b"x")]
    alone = [next(suffix_dedup.each_parsed([t])) for t in texts]
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    got = list(suffix_dedup.each_parsed(texts))
    assert len(got) == len(texts) and all(np.array_equal(x, y) for a, g in zip(alone, got, strict=True) for x, y in zip(a, g, strict=True))
    for t, (_, _, first, last) in zip(texts, got, strict=True):
        starts = [i for a, b in zip(first, last, strict=True) for i in range(a, b)]
        assert starts == list(range(len(t) - 199))


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    rows, base = [], rng.standard_normal((60, 64))
    for i, v in enumerate(base):
        rows.append((v, i % 3))
        for _ in range(i % 4):
            rows.append((v + rng.standard_normal(64) * rng.choice([0.05, 0.2, 0.35, 0.45]), i % 3))
    rows += [(base[0], 0)] * 5 + [(base[0], 1), (base[0], None), (base[0] * 7, 0)]
    table = [(i * 2, v.tolist(), label, "e") for i, (v, label) in enumerate(rows)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [None] + [1.0] * 63]
    table += [(1001 + 2 * i, v, 0, "e") for i, v in enumerate(odd)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, code string")
    x = np.stack([v for v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = [(2 * a, 2 * b) for a in range(len(rows)) for b in range(a) if rows[a][1] is not None and rows[a][1] == rows[b][1] and x[a] @ x[b] >= 0.93]
    want, got = roots([r[0] for r in table], links), {r.vec_id: r for r in embed_dedup.near_duplicates(df, spark).collect()}
    n = {i: sum(i in e for e in links) for i in got}
    assert len(got) == len(table) and all(got[i].n_links <= n[i] for i in n)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n.values()) > 0
    assert sum(got[i].component_id == want[i] for i in want) >= 0.97 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embed_dedup.near_duplicates(df.limit(0), spark).count() == 0


def test_vectors_of_several_lengths(spark):
    """Each length is indexed, however few vectors have it; a rare length, ties, repeated rows and ids, huge and tiny numbers."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(64), 0) for i in range(200)]
    a, b = rng.standard_normal(32), rng.standard_normal(3)
    rows += [(300, a, 0), (301, a + 0.01 * rng.standard_normal(32), 0), (302, b, 0), (303, b * 1.01, 0), (304, np.ones(1), 0), (305, np.ones(1) * 2, 0), (306, -np.ones(1), 0)]
    rows += [(307, np.full(64, 1e200), 0), (308, np.full(64, 1e-200), 0), (309, rows[5][1], 0), (309, rows[5][1], 0), (None, rows[5][1], 0)]
    df = spark.createDataFrame([(i, v.tolist(), label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
    got = embed_dedup.near_duplicates(df, spark).collect()
    linked = {r.vec_id: (r.n_links, r.component_id) for r in got if r.n_links}
    assert len(got) == len(rows)
    assert linked == {5: (1, 5), 309: (1, 5), 300: (1, 300), 301: (1, 300), 302: (1, 302), 303: (1, 302), 304: (1, 304), 305: (1, 304), 307: (1, 307), 308: (1, 307)}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


@pytest.mark.parametrize("dim", [32, 64, 256])
@pytest.mark.parametrize("mean", [0.0, 0.3, 0.7])
def test_recall_in_each_band(dim, mean):
    """Pairs just above the threshold are found too, also where vectors share a mean direction."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((4000, dim)) / np.sqrt(dim) * np.sqrt(1 - mean) + np.sqrt(mean) * np.eye(1, dim)
    x = embed_dedup.unit(x)
    m = embed_dedup.learn(x[:2000], 50_000)
    assert m["tables"] <= embed_dedup.TABLES
    for low in (0.93, 0.94, 0.95, 0.97, 0.99):
        a, b = embed_dedup.pairs_at(x[2000:], low + 0.002, rng, 1500)
        same = ((a - m["mean"]) @ m["projection"] >= 0) == ((b - m["mean"]) @ m["projection"] >= 0)
        hit = same.reshape(len(a), m["tables"], m["width"]).all(axis=2).any(axis=1) & ((~same).sum(axis=1) <= m["near"])
        assert hit.mean() >= 0.95, (low, hit.mean(), m["tables"], m["width"])
