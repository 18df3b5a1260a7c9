"""Ranking with bounds and the join by containment, against plain Python over all pairs."""

import math
import random
import re
from collections import Counter

import pytest

from quillon.operators import metrics, ranking, substring

VOCABULARY = [f"w{i}" for i in range(40)] + [f"rare{i}" for i in range(200)]


def some_text(rng, n):
    return " ".join(rng.choice(VOCABULARY[: 1 + int(240 * rng.random() ** 3)]) for _ in range(n))


def plain_bm25(questions, units, b, top_k, k1=1.2):
    """(query_id, rank, unit_id, score to nine digits) for questions (id, text, allowed or None)."""
    tokens = {u: re.findall("[a-z0-9]+", t) for u, _, t in units}
    average = sum(map(len, tokens.values())) / len(tokens)
    df = Counter(w for t in tokens.values() for w in set(t))
    out = []
    for q, text, allowed in questions:
        scored = []
        for u, d, _ in units:
            if allowed is not None and d not in allowed:
                continue
            tf = Counter(tokens[u])
            idf = lambda w: max(0.0, math.log((len(units) - df[w] + 0.5) / (df[w] + 0.5)))
            s = sum(idf(w) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(tokens[u]) / average)) for w in set(text.split()) if tf[w])
            scored.append((-round(s, 9), u))
        out += [(q, r, u, -s) for r, (s, u) in enumerate(sorted(scored)[:top_k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    return [(f"u{i:04d}", f"d{i % 60}", some_text(rng, rng.randint(0, 60))) for i in range(700)] + [(f"z{i}", f"d{i}", "w0 w1 w2 w3") for i in range(9)]


@pytest.mark.parametrize("seeds, block", [(16_384, 512), (5, 2), (0, 1)])
@pytest.mark.parametrize("everything", [False, True])
def test_bm25_against_all_pairs(spark, corpus, monkeypatch, seeds, block, everything):
    """Whatever the bounds are made of: thresholds that are known, loose or missing, blocks of any size."""
    monkeypatch.setattr(ranking, "SEEDS", seeds)
    monkeypatch.setattr(ranking, "BLOCK", block)
    rng = random.Random(9)
    questions = [(f"q{i}", some_text(rng, rng.randint(1, 30)), [f"d{k}" for k in rng.sample(range(62), rng.choice([0, 1, 3, 60]))]) for i in range(25)]
    questions += [("none", "unknown words", ["d1", "d2"]), ("blank", "", ["d3"]), ("copies", "w0 w1 w2 w3", [f"d{i}" for i in range(60)])]
    units = spark.createDataFrame(corpus, "unit_id string, doc_id string, text string")
    asked = spark.createDataFrame(questions, "query_id string, question string, allowed_doc_ids array<string>")
    if everything:
        asked, questions = asked.drop("allowed_doc_ids"), [(q, t, None) for q, t, _ in questions]
    got = ranking.bm25_arms(asked, units, {"a": 0.75, "b": 0.0}, top_k=4).collect()
    for arm, b in (("a", 0.75), ("b", 0.0)):
        want = plain_bm25(questions, corpus, b, 4)
        mine = sorted((r.query_id, r.rank, r.unit_id, round(r.score, 9)) for r in got if r.arm == arm)
        assert [w[:3] for w in mine] == [w[:3] for w in want] and all(abs(x[3] - y[3]) < 2e-9 for x, y in zip(mine, want, strict=True))


def test_bounds_pass_over_units(spark):
    """Of many units that share common words only those that can be among the best are scored."""
    rng = random.Random(10)
    common = [f"c{i}" for i in range(30)]
    rows = [(f"u{i}", f"d{i}", " ".join(rng.sample(common, 8))) for i in range(3000)] + [(f"best{i}", f"b{i}", "needle other thing " + " ".join(common[:8])) for i in range(6)]
    words = ranking.tokenized(spark.createDataFrame(rows, "unit_id string, doc_id string, text string"))
    asked = spark.createDataFrame([("q", w) for w in ["needle", "other", "thing", *common[:8]]], "query_id string, token string")
    index = ranking.indexed(words, asked, [0.75])
    assert {r.unit_id for r in ranking.contenders(asked, index, None, 1, 4).collect()} == {f"best{i}" for i in range(6)}


def test_paragraph_ids_stay_in_items(spark):
    units = spark.createDataFrame([("d|0|1", "d", 0, 1, "alpha beta")], "unit_id string, doc_id string, paragraph_idx int, subparagraph_idx int, text string")
    q = spark.createDataFrame([("q", "alpha", ["d"])], "query_id string, question string, allowed_doc_ids array<string>")
    row = ranking.nested(q, ranking.with_text(ranking.bm25(q, units), units), "bm25").first()
    assert (row.retrieved_items[0].paragraph_idx, row.retrieved_items[0].subparagraph_idx) == (0, 1)


@pytest.mark.parametrize("run", [1, 2, 3])
def test_containment_against_all_pairs(spark, run):
    rng = random.Random(run)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.randint(1, 4)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 25)))) for i in range(150)] + [(900, None), (901, "")]
    needles = [(i, " ".join(word() for _ in range(rng.randint(1, 2)))) for i in range(40)]
    for i in range(40, 160):  # pieces of texts, cut anywhere
        t = rng.choice(texts[:150])[1]
        a = rng.randrange(len(t) + 1)
        needles.append((i, t[a : a + rng.randint(1, 40)].strip()))
    needles += [(500, ""), (501, None)]
    got = substring.containing(spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(texts, "text_id long, text string"), run)
    want = {(i, j) for i, n in needles if n for j, t in texts if t and n in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_relevant_units_and_their_evidence(spark):
    """Both directions, short and empty gold answers, units of few tokens, and the gold answer as evidence."""
    units = [("u1", "d1", "The cat sat on the mat today"), ("u2", "d2", "cat sat on the"), ("u3", "d1", "the cat"), ("u4", "d3", "cats at on the mats"), ("u5", "d2", "x y z 2019 12")]
    questions = [("q1", "The CAT sat on the mat", ["d1", "d2"]), ("q2", "1", ["d2"]), ("q3", "", ["d1"]), ("q4", "at on", ["d1", "d3"]), ("q5", "The CAT sat on the mat", ["d3"])]
    q = spark.createDataFrame(questions, "query_id string, golden_answer string, allowed_doc_ids array<string>")
    u = spark.createDataFrame(units, "unit_id string, doc_id string, text string")
    got = {(r.query_id, r.unit_id): (r.doc_id, r.relevance, r.evidence) for r in metrics.substring_qrels(q, u).collect()}
    gold = dict((i, g) for i, g, _ in questions)
    assert got == {k: (d, 1, gold[k[0]]) for k, d in {("q1", "u1"): "d1", ("q1", "u2"): "d2", ("q2", "u5"): "d2", ("q3", "u1"): "d1", ("q4", "u1"): "d1", ("q4", "u4"): "d3"}.items()}
    anywhere = {(r.query_id, r.unit_id) for r in metrics.substring_qrels(q.drop("allowed_doc_ids"), u).collect()}
    assert anywhere == {("q1", "u1"), ("q1", "u2"), ("q5", "u1"), ("q5", "u2"), ("q2", "u5"), ("q4", "u1"), ("q4", "u2"), ("q4", "u4"), *[("q3", f"u{i}") for i in (1, 2, 4, 5)]}
