"""Handoffs whose runs have contexts of their own, checks of outputs, anchors outside the allowed documents."""

from __future__ import annotations

from collections import Counter

import pytest
from test_plans import SF, rows_of

from quillon.operators import checks, metrics, windows
from quillon.plans import pipelines, queries

ITEM = "array<struct<rank: int, unit_id: string, doc_id: string, text: string, score: double>>"


@pytest.mark.parametrize("name", ["handoff_summary", "dq_outputs", "relaxed_bigram_flags", "presence_means"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(con.sql(queries.ORACLES[name]).df())


def arm(spark, rows, name, **contexts):
    data = [(q, name, gold, [(i + 1, f"u{i}", "d", t, 1.0) for i, t in enumerate(texts)], "", *[c.get(q) for c in contexts.values()]) for q, gold, texts in rows]
    extra = "".join(f", {c} string" for c in contexts)
    return spark.createDataFrame(data, f"query_id string, arm string, golden_answer string, retrieved_items {ITEM}, retrieval_error string{extra}")


ROWS = [
    ("q1", "a b a b", ["a b", "a b", "c", "a"]),  # bigrams over borders, a repeated one
    ("q2", "one", ["no", "One.", "", "x"]),
    ("q3", "", ["a", "b"]),
    ("q4", "a b c d", ["", "a", "b c", "d"]),
    ("q5", "a b c", []),
    ("q6", "b b b b", ["b", "b", "b b", "b"]),
]


def wanted(gold, contexts):
    g = gold.split()
    pairs = lambda t: Counter(zip(t, t[1:], strict=False))
    for c in contexts:
        t = c.lower().replace(".", "").split()
        near = False if not g else g[0] in t if len(g) == 1 else sum((pairs(g) & pairs(t)).values()) >= len(g) - 2
        yield bool(g) and " ".join(g) in " ".join(t), near


def test_flags_with_own_contexts(spark):
    own = {"containment_context_1": {"q1": "x a b a b", "q4": "a b c"}, "containment_context_3": {"q1": "", "q2": "none"}}
    rows = pipelines.assemble.stacked(arm(spark, ROWS, "plain"), arm(spark, ROWS, "own", **own))
    flags = metrics.containment(rows).join(metrics.relaxed(rows), ["query_id", "arm"])
    got = {(r.query_id, r.arm): r for r in flags.collect()}
    assert len(got) == 12
    for q, gold, texts in ROWS:
        for name in ("plain", "own"):
            contexts = [own.get(f"containment_context_{k}", {}).get(q, " ".join(texts[:k])) if name == "own" else " ".join(texts[:k]) for k in range(1, 5)]
            have = [(got[q, name][f"exact_{k}"], got[q, name][f"relaxed_{k}"]) for k in range(1, 5)]
            assert have == list(wanted(gold, contexts)), (q, name)


def test_summary_of_a_handoff(spark):
    failed = arm(spark, ROWS[:2], "a").withColumn("retrieval_error", queries.F.when(queries.F.col("query_id") == "q1", "timeout"))
    questions = spark.createDataFrame([("q1", "a b a b", ["d"]), ("q2", "one", ["d", "e"])], "query_id string, golden_answer string, allowed_doc_ids array<string>")
    documents = spark.createDataFrame([("d", "x a b a b"), ("e", "two")], "doc_id string, text string")
    qrels = spark.createDataFrame([("q1", "u1"), ("q2", "u9")], "query_id string, unit_id string")
    flags, _, rates = pipelines.handoff(questions, documents, [failed], qrels)
    r = pipelines.handoff_summary(flags, rates).first()
    assert (r.n_questions, r.retrieval_errors, r.mean_exact_full, r.mean_exact_1, r.mean_exact_2, r.recall_1, r.recall_2, r.hit_4) == (2, 1, 0.5, 0.0, 1.0, 0.0, 0.5, 0.5)
    assert "recall_1" not in pipelines.handoff_summary(flags).columns


def test_outputs_of_another_model(spark):
    work = spark.createDataFrame([("q1", "a"), ("q2", "a"), ("q3", "a")], "query_id string, arm string")
    made = spark.createDataFrame([("q1", "a", "m", "said", ""), ("q1", "a", None, " ", ""), ("q2", "a", "n", "said", "boom"), ("q9", "a", "m", "said", None)], "query_id string, arm string, model string, generated_answer string, generation_error string")
    judged = spark.createDataFrame([("q1", "a", "j", "CORRECT", "r", ""), ("q2", "a", "j", "Correct", "", ""), ("q3", "a", "j", None, "r", "e")], "query_id string, arm string, judge_model string, verdict string, reason string, judge_error string")
    got = {r["check"]: r.n_violations for r in checks.outputs(work, made, judged, {"model": "m"}, {"judge_model": "j"}).collect()}
    assert got == {"generation_missing": 1, "generation_unknown": 1, "generation_unique_query_id_arm": 1, "generation_other_model": 2, "generation_generation_error": 1, "generation_blank_answer": 1,
                   "judgment_missing": 0, "judgment_unknown": 0, "judgment_unique_query_id_arm": 0, "judgment_other_judge_model": 0, "judgment_judge_error": 1, "judgment_verdict": 2, "judgment_blank_reason": 1}
    with pytest.raises(checks.CheckFailed):
        checks.identities(made, effort="low")


def test_anchors_in_documents_that_are_not_allowed(spark):
    anchors = spark.createDataFrame([(q, k, "d", 0, k) for q in ("q1", "q2", "q3") for k in range(1, 5)], "query_id string, rank int, doc_id string, paragraph_idx int, sentence_idx int")
    sentences = spark.createDataFrame([("d", 0, k) for k in range(6)], "doc_id string, paragraph_idx int, sentence_idx int")
    questions = spark.createDataFrame([("q1", ["d", "e"]), ("q2", ["e"]), ("q3", None)], "query_id string, allowed_doc_ids array<string>")
    assert windows.anchor_faults(anchors, sentences).isEmpty()
    got = windows.anchor_faults(anchors, sentences, questions=questions).collect()
    assert sorted(map(tuple, got)) == [("q2", "document not allowed"), ("q3", "document not allowed")]
