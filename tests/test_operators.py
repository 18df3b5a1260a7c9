import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators import assemble, checks, metrics, paired, ranking, sampling, windows


def brute_bm25(questions, units, k=4, k1=1.2, b=0.75):
    toks = {u: t.split() for u, _, t in units}
    n, avg = len(units), sum(map(len, toks.values())) / len(units)
    df = Counter(w for t in toks.values() for w in set(t))
    out = {}
    for q, text, allowed in questions:
        scored = []
        for u, d, _ in units:
            if d in allowed:
                tf, s = Counter(toks[u]), 0.0
                for w in dict.fromkeys(text.split()):
                    if tf[w]:
                        s += max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 0) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(toks[u]) / avg))
                scored.append((-round(s, 9), u, s))
        out[q] = [(u, s) for _, u, s in sorted(scored)[:k]]
    return out


def test_bm25_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou")
    units = [(f"u{i:03}", f"d{i % 20}", " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(120)]
    questions = [(f"q{i}", " ".join(word() for _ in range(8)), [f"d{j}" for j in rng.sample(range(22), rng.randint(0, 9))]) for i in range(25)]
    q = spark.createDataFrame(questions, "query_id string, question string, allowed_doc_ids array<string>")
    u = spark.createDataFrame(units, "unit_id string, doc_id string, text string")
    got: dict = {}
    for r in ranking.bm25(q, u).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.unit_id, r.score))
    for name, want in brute_bm25(questions, units).items():
        assert [x[0] for x in got.get(name, [])] == [x[0] for x in want]
        assert [x[1] for x in got.get(name, [])] == pytest.approx([x[1] for x in want])
    rows = {r.query_id: r for r in ranking.wide(ranking.nested(q, ranking.with_text(ranking.bm25(q, u), u), "bm25")).collect()}
    empty = next(x for x in questions if not x[2] or all(d not in {v[1] for v in units} for d in x[2])) if any(not x[2] for x in questions) else None
    assert len(rows) == 25
    if empty:
        assert rows[empty[0]].retrieved_count == 0 and rows[empty[0]].excerpt_1 == "" and rows[empty[0]].excerpt_1_score is None
    assert ranking.bm25(q, u.limit(0)).count() == 0


def test_from_wide_keeps_ranks(spark):
    df = spark.createDataFrame([("q", "a", " ", "nan", "d")], "query_id string, excerpt_1 string, excerpt_2 string, excerpt_3 string, excerpt_4 string")
    assert [(i.rank, i.text) for i in ranking.from_wide(df).first().retrieved_items] == [(1, "a"), (4, "d")]
    neural = ranking.import_ranked(spark.createDataFrame([("q", "a\n...\nb")], "query_id string, t string"), "t", "n").first()
    assert [(i.rank, i.text) for i in neural.retrieved_items] == [(1, "a"), (2, "b")] and neural.retrieval_error == ""


def test_windows(spark):
    sentences = spark.createDataFrame([("d", i, i, 0, f"s{i}") for i in range(10)], "doc_id string, sentence_ordinal long, paragraph_idx long, sentence_idx long, text string")
    anchors = spark.createDataFrame([("q", 1, "d", 0, 0), ("q", 2, "d", 1, 0), ("q", 3, "d", 9, 0), ("q", 4, "d", 5, 0)], "query_id string, rank int, doc_id string, paragraph_idx long, sentence_idx long")
    w = windows.expand(anchors, sentences)
    text = {r["rank"]: r.window_text for r in windows.rendered(w, by_rank=True).collect()}
    assert text == {1: "s0 s1 s2", 2: "s3", 3: "s7 s8 s9", 4: "s4 s5 s6"}
    assert windows.rendered(w, by_rank=False).first().window_text == "s0 s1 s2 s3 s4 s5 s6 s7 s8 s9"
    assert windows.duplicates_dropped(w).first()[1:] == (5, 10)
    gap = anchors.where("rank IN (1, 3)")
    assert windows.rendered(windows.expand(gap, sentences), by_rank=False).first().window_text == "s0 s1 s2 [...] s7 s8 s9"
    assert windows.rendered(windows.expand(gap, sentences), by_rank=False, gap=None).first().window_text == "s0 s1 s2 s7 s8 s9"
    assert windows.anchor_faults(anchors, sentences).count() == 0 and windows.anchor_faults(gap, sentences).count() == 1


def test_judge_summary(spark):
    rows = [("a", "CORRECT", 5.0, "", ""), ("a", "INCORRECT", None, "", "content_filter"), ("a", "CORRECT", 1.0, "", ""), ("a", "", None, "boom", ""), ("a", "CORRECT", float("nan"), "", "content_filter")]
    df = spark.createDataFrame([(*r, 10) for r in rows], "arm string, verdict string, score double, judge_error string, judge_fallback string, judge_total_tokens long")
    r = metrics.judge_summary(df, "arm").first()
    assert (r.n_rows, r.n_errors, r.mean_score, r.n_scored, r.n_ignored, r.accuracy, r.score_5, r.score_1) == (5, 1, 3.0, 2, 2, 0.75, 1, 1)
    r = metrics.judge_summary(metrics.failures_as_one(df), "arm").first()
    assert (r.n_errors, r.n_scored, r.score_1) == (0, 3, 2) and r.mean_score == pytest.approx(7 / 3)


def test_recall_and_full_document(spark):
    ranked = spark.createDataFrame([("q1", "a", 1, "u1"), ("q1", "a", 2, "u9"), ("q1", "a", 3, "u2"), ("q2", "a", 1, "u7")], "query_id string, arm string, rank int, unit_id string")
    qrels = spark.createDataFrame([("q1", "u1"), ("q1", "u2"), ("q2", "u8")], "query_id string, unit_id string")
    got = {r.k: (r.recall, r.hit, r.n_questions) for r in metrics.recall_hit(ranked, qrels).collect()}
    assert got == {1: (0.25, 0.5, 2), 2: (0.25, 0.5, 2), 3: (0.5, 0.5, 2), 4: (0.5, 0.5, 2)}
    none = metrics.recall_hit(ranked, qrels.limit(0)).first()
    assert none.recall is None and none.hit is None
    q = spark.createDataFrame([("q1", "b c", ["1", "2"]), ("q2", "c b", ["1", "2"]), ("q3", "x", [])], "query_id string, golden_answer string, allowed_doc_ids array<string>")
    docs = spark.createDataFrame([(1, "a a a a a b"), (2, "c d d d d d")], "doc_id long, text string")
    assert {r.query_id: r.exact_full for r in metrics.full_document(q, docs).collect()} == {"q1": True, "q2": False, "q3": False}


def test_paired(spark):
    long = spark.createDataFrame([(f"q{i}", arm, (i * (3 if arm == "x" else 5)) % 5 + 1) for i in range(30) for arm in ("x", "y")] + [("only", "x", 3)], "query_id string, arm string, score int")
    pairs = paired.paired(long, "x", "y", "score")
    want = [((i * 3) % 5 + 1, 1) for i in range(30)]
    r = paired.deltas(pairs).first()
    assert (r.n, r.wins, r.losses, r.ties) == (30, sum(a > b for a, b in want), sum(a < b for a, b in want), sum(a == b for a, b in want))
    assert sum(r[f"delta_{s}{k}"] for s, k in [("m", 4), ("m", 3), ("m", 2), ("m", 1), ("p", 0), ("p", 1), ("p", 2), ("p", 3), ("p", 4)]) == 30
    t = paired.transitions(pairs).first()
    assert sum(t) == 30 and t.from_3_to_1 == want.count((3, 1))
    c = paired.contingency(pairs.select("query_id", (F.col("a") > 2).alias("a"), (F.col("b") > 2).alias("b"))).first()
    assert (c.both, c.b_only) == (0, 0) and c.a_only == sum(a > 2 for a, _ in want)


def test_assemble(spark):
    a = spark.createDataFrame([(1, "old", "q"), (2, "old", "q")], "k int, v string, extra string")
    b = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert {(r.k, r.v, r.extra) for r in assemble.upserted(a, b, keys=["k"]).collect()} == {(1, "old", "q"), (2, "new", None), (3, "new", None)}
    prior = spark.createDataFrame([(1, ""), (2, "boom"), (3, None)], "k int, error string")
    assert {r.k for r in assemble.pending(spark.range(1, 6).selectExpr("int(id) AS k"), prior, ["k"], "error").collect()} == {2, 4, 5}
    table = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "k int, v string, o int")
    assert [r.name for r in assemble.lookup(a, table, "k", "v", "o", "name").orderBy("k").collect()] == ["y", None]
    rows = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C"), (3, "D")], "o int, t string")
    source = spark.createDataFrame([(0, "A"), (1, "X"), (2, "B"), (3, "D"), (4, "D"), (5, "D")], "o int, t string")
    got = assemble.aligned(rows, source, "o", F.col("t"), F.col("t")).orderBy("o").collect()
    assert [r.matched_row for r in got] == [0, 2, None, 3]
    assert [r.v for r in assemble.by_enumeration(spark.createDataFrame([("b",), ("z",), ("a",)], "v string"), "v", ["a", "b"]).collect()] == ["a", "b", "z"]


def test_checks_and_samples(spark):
    df = spark.createDataFrame([("q1", "", 1), ("q1", "x", 2), (None, "y", 3)], "query_id string, v string, n int")
    report = checks.together(checks.unique(df, ["query_id"]), checks.conditions(df, blank=F.col("v") == "", null_key=F.col("query_id").isNull()), checks.subset("known", df.where("query_id IS NOT NULL"), df.where("n = 3"), ["query_id"]))
    assert {r["check"]: r.n_violations for r in report.collect()} == {"unique_query_id": 1, "blank": 1, "null_key": 1, "known": 2}
    with pytest.raises(checks.CheckFailed, match="blank: 1"):
        checks.require(report)
    with pytest.raises(checks.CheckFailed, match="missing"):
        checks.columns_present(df, ["nope"])
    q = spark.range(300).selectExpr("concat('q', id) AS query_id", "id AS source_row", "if(id % 2 = 0, 'dev', 'test') AS split")
    s = sampling.stable_sample(q, 20, "salt").collect()
    assert len(s) == 20 and [r.selection_rank for r in s] == list(range(1, 21)) and [r.selection_key for r in s] == sorted(r.selection_key for r in s)
    assert [r.query_id for r in sampling.stable_sample(q.repartition(7), 20, "salt").collect()] == [r.query_id for r in s]
    assert sampling.set_hash(q, "split").first() == sampling.set_hash(q.limit(10), "split").first()
    cells = spark.createDataFrame([("b", "long", 0.5), ("c", "xx", 0.5), ("a", "yy", 0.5), ("d", "z", 0.1)], "prompt_name string, prompt string, accuracy double")
    assert sampling.prompt_winner(cells).first().prompt_name == "a"
