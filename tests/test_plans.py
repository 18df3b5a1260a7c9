import gzip
import json
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.operators import checks
from quillon.plans import answers, pipelines, queries
from quillon.sources import archives, sinks, tables
from quillon.streaming import incremental

SF = "/root/testdata/sf0.001"
QUICK = ["norm_tokens", "slug_values", "json_object_extract", "label_parse", "units_paragraph", "bm25_top4_document", "exact_topk_flags", "relaxed_bigram_flags", "window_render_gap", "judge_summary", "paired_delta_hist", "sign_test_by_customer", "union_missing_cols", "upsert_latest", "lookup_last_wins", "running_ordinals", "stub_generate", "stub_judge", "resumed_generate", "timed_attempts", "dq_result_violations", "dq_doc_filter", "compound_ids", "role_swap", "aligned_rows", "usage_fields", "imported_rankings", "presence_means", "paired_means", "paired_histograms", "label_rates", "published_metrics", "window_audit", "cohort_faults", "dq_agreements", "csv_and_json_read_back", "parts_in_path_order", "matched_rows", "joined_by_position", "windows_of_hits", "prompt_texts", "json_lists", "generation_summary", "dq_handoff", "dq_matrix", "dq_package", "dq_development"]


def rows_of(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.isna(v) else round(float(v), 8) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return sorted(map(str, ([plain(v) for v in r] for r in df.itertuples(index=False))))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "events", "orders", "lineitem", "labels", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(con.sql(queries.ORACLES[name]).df())


def test_registry():
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and len(queries.QUERIES) > 40


@pytest.fixture
def work(spark):
    rows = [(f"q{i}", "bm25", f"question {i}?", "gold", "" if i % 5 == 0 else f"context number {i}") for i in range(20)]
    return spark.createDataFrame(rows, "query_id string, arm string, question string, golden_answer string, context string")


def test_generation_resumes(spark, work, tmp_path):
    def flaky(p):
        if "question 7?" in p:
            raise ValueError("no")
        return answers.stub_writer(p)

    keys = ["query_id", "arm"]
    run = lambda adapter: answers.resumed(spark, work, lambda df: answers.generated(df, adapter, "m", "v"), str(tmp_path / "c"), answers.GENERATION, keys, "generation_error", 3).toPandas()
    first = run(flaky).set_index("query_id")
    assert len(first) == 20 and (first["generation_error"] != "").sum() == 1 and "ValueError" in first.loc["q7", "generation_error"]
    assert (first.loc[["q0", "q5"], "generated_answer"] == answers.REFUSAL).all() and (first.loc[["q0", "q5"], "input_tokens"] == 0).all()
    called = []

    def later(p):  # runs in another process: what it did shows in the rows
        return answers.Reply("later")

    second = run(later).set_index("query_id")
    called = second.index[second["generated_answer"] == "later"].tolist()
    assert called == ["q7"] and (second["generation_error"] == "").all()
    with pytest.raises(checks.CheckFailed):
        pipelines.generate(spark, work, flaky, "m", "v", str(tmp_path / "d"), 2)


def test_judging(spark, work):
    made = answers.generated(work, answers.stub_writer, "m", "v").withColumn("generation_error", F.when(F.col("query_id") == "q3", "boom").otherwise(F.col("generation_error")))

    def odd(p):
        if "question 4?" in p:
            raise answers.Refused("filter")
        if "question 6?" in p:
            return answers.Reply('{"verdict": "MAYBE", "score": 9, "reason": "x"}')
        if "question 8?" in p:
            return answers.Reply('{"verdict": "CORRECT", "score": 2, "reason": "x", "more": 1}')
        return answers.stub_judge(p)

    for mode in ("binary", "scale-1-5"):
        out, summary = pipelines.judge(work, made, odd, "j", mode)
        got = {r.query_id: r for r in out.collect()}
        assert got["q3"].judge_error == "generation_error" and (got["q4"].judge_fallback, got["q4"].judge_error, got["q4"].score) == (answers.FILTERED, "", None)
        assert got["q3"].verdict == got["q4"].verdict == ("INCORRECT" if mode == "binary" else "")
        assert got["q6"].judge_error == got["q8"].judge_error == "invalid object"
        assert got["q1"].judge_error == "" and (got["q1"].verdict in ("CORRECT", "INCORRECT")) == (mode == "binary") and (got["q1"].score is None) == (mode == "binary")
        assert summary.first().n_errors == 3
    lenient = answers.judged(work.join(made.drop("arm"), "query_id"), lambda p: answers.Reply('{"why": "because", "score": 4, "more": 2}'), "j", "scale-1-5", lenient=True).first()
    assert (lenient.score, lenient.reason) == (4, "because")
    for reply, reason in (('{"score": 4, "note": "x", "reason": "y"}', "y"), ('{"score": 4}', answers.NO_REASON)):
        assert answers.judged(work.join(made.drop("arm"), "query_id"), lambda p, r=reply: answers.Reply(r), "j", "scale-1-5", lenient=True).first().reason == reason


def test_invalid_judgments_are_asked_for_again(spark, work, tmp_path):
    made = answers.generated(work, answers.stub_writer, "m", "v")

    def third(p):
        seen = tmp_path / answers.hashlib.sha256(p.encode()).hexdigest()
        n = int(seen.read_text()) if seen.exists() else 0
        seen.write_text(str(n + 1))
        return answers.stub_judge(p) if n == 2 else answers.Reply('{"verdict": "CORRECT", "score": 3, "reason": "both"}')

    out, _ = pipelines.judge(work, made, third, "j", "binary", checkpoint=str(tmp_path / "c"), batches=2)
    rows = out.collect()
    assert len(rows) == 20 and {r.judge_error for r in rows} == {""} and {r.reason for r in rows} == {"stub"}
    again, _ = pipelines.judge(work, made, lambda p: answers.Reply("never called"), "j", "binary", checkpoint=str(tmp_path / "c"), batches=2)
    assert sorted(again.collect()) == sorted(rows)
    empty = answers.generated(work.where("query_id = 'q1'"), lambda p: answers.Reply("  "), "m", "v").first()
    assert (empty.generated_answer, empty.generation_error) == ("", "ValueError")
    right = answers.judged_boolean(made.join(work.drop("arm"), "query_id"), lambda p: answers.Reply('{"correct": true}' if "question 2?" in p else '{"correct": "yes"}'), "j").collect()
    assert sum(r.judge_correct for r in right) == 1 and sum(r.judge_error == "ValueError" for r in right) == 19


def test_paired_matrix(spark, work, tmp_path):
    both = work.unionByName(work.withColumn("arm", F.lit("neural")).withColumn("context", F.concat("context", F.lit(" more"))))
    judges = {"strict": (answers.stub_judge, "binary"), "scale": (answers.stub_judge, "scale-1-5")}
    made, judged, paired = pipelines.paired_matrix(spark, both, ("bm25", "neural"), {"m/1": answers.stub_writer, "m/2": answers.stub_writer}, judges, "v", str(tmp_path))
    assert made.count() == 80 and judged.count() == 160
    rows = {(r.generator, r.judge): r for r in paired.collect()}
    assert len(rows) == 4 and all(r.n == 20 and abs(r.a_mean - r.b_mean - r.difference) < 1e-9 for r in rows.values())
    assert sum(rows["m/1", "scale"][f"a_score_{k}"] for k in range(1, 6)) == 20 and rows["m/1", "strict"].a_score_1 is None
    with pytest.raises(checks.CheckFailed, match="paired_keys"):
        pipelines.paired_matrix(spark, both.where("NOT (arm = 'neural' AND query_id = 'q3')"), ("bm25", "neural"), {}, {}, "v", str(tmp_path))


def test_development_rows(spark):
    rows = [("d", f"q{i}", "dev" if i % 4 else "test", i, "q", "a", "bm25", "c", "") for i in range(40)]
    names = ["dataset", "query_id", "split", "source_row", "question", "golden_answer", "retrieval_method", "retrieved_context", "retrieval_error"]
    df = spark.createDataFrame(rows, names)
    assert pipelines.development_rows(df, "bm25", 20).count() == 20
    for bad, name in ((df.union(df.limit(1)), "unique"), (df.withColumn("retrieval_error", F.lit("x")), "error"), (df.withColumn("retrieval_method", F.lit("x")), "method"), (df.where("source_row < 9"), "development")):
        with pytest.raises(checks.CheckFailed, match=name):
            pipelines.development_rows(bad, "bm25", 20)
    with pytest.raises(checks.CheckFailed, match="missing"):
        pipelines.development_rows(df.drop("split"), "bm25")


def test_retries():
    waits, left = [], [3]

    def call():
        left[0] -= 1
        if left[0]:
            raise answers.Transient("again")
        return answers.Reply("ok")

    assert answers.retried(call, sleep=waits.append).text == "ok" and len(waits) == 2 and all(w <= 60 for w in waits)
    with pytest.raises(answers.Transient):
        answers.retried(lambda: (_ for _ in ()).throw(answers.Transient("x")), attempts=2, sleep=waits.append)
    with pytest.raises(RuntimeError, match="b: no"):
        answers.settled({"a": lambda: 1, "b": lambda: (_ for _ in ()).throw(ValueError("no"))})
    assert answers.reply_text([{"text": "a"}, "b"]) == "ab"


def test_stream(spark, work, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: incremental.processed(incremental.questions(spark, source, work.schema.simpleString()[7:-1].replace(":", " ")), lambda df: answers.generated(df, answers.stub_writer, "m", "v"), sink, answers.GENERATION, ["query_id", "arm"], "generation_error", str(tmp_path / "state")).awaitTermination()
    work.limit(12).write.mode("append").parquet(source)
    run()
    work.write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(sink)
    assert got.count() == got.select("query_id").distinct().count() == 20


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, "", 0.5)], "k long, t string, v double")
    sinks.write_summary(df, str(tmp_path / "s"))
    assert json.loads((tmp_path / "s.json").read_text())[0] == {"k": 1, "t": 'a "q", b', "v": None}
    back = tables.csv(spark, str(tmp_path / "s.csv"), "k long, t string, v string").collect()
    assert (back[0].t, back[1].t) == ('a "q", b', "")
    sinks.write_table(df, str(tmp_path / "t"), "k")
    assert tables.routed(spark, str(tmp_path / "t"), k="1").count() == 1
    with pytest.raises(ValueError, match="lacks"):
        tables.parquet(spark, str(tmp_path / "t"), "nope")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert tables.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2
    df.toPandas().to_parquet(tmp_path / "m.parquet")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "m.parquet", "m.parquet")
        z.writestr("n.csv.gz", gzip.compress(b'k,t,w\n3,"",x\n'))
    got = archives.archive(spark, str(tmp_path / "z.zip"), {"m.parquet": "parquet", "n.csv.gz": "csv.gz"})
    assert {(str(r.k), r.t, r.w) for r in got.collect()} == {("1", 'a "q", b', None), ("2", "", None), ("3", "", "x")}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("a")
    listed = spark.createDataFrame(tables.files(spark, str(tmp_path / "files")).toPandas())
    (tmp_path / "files" / "a.txt").write_text("b")
    (tmp_path / "files" / "b.txt").write_text("b")
    (tmp_path / "files" / "c d%é.pyc").write_text("skipped")
    assert {r.path.rsplit("/", 1)[1]: r.problem for r in pipelines.manifest(spark, str(tmp_path / "files"), listed).collect()} == {"a.txt": "changed", "b.txt": "unlisted"}


def test_matrix_variants(spark, work, tmp_path):
    both = work.unionByName(work.withColumn("arm", F.lit("neural")))
    seen = tmp_path / "prompt"

    def writer(p):
        seen.write_text(p)
        return answers.stub_writer(p)

    made, judged, _, summary = pipelines.dual_label_matrix(spark, both, ("bm25", "neural"), {"m": writer}, {"strict": (answers.stub_judge, "binary")}, str(tmp_path / "dual"))
    assert "True/Entailment or False/Contradiction" in seen.read_text().split("\n")[0] and {(r.arm, r.questions, r.n_unsent) for r in summary.collect()} == {("bm25", 20, 4), ("neural", 20, 4)}
    assert judged.count() == 40
    old = spark.createDataFrame([("m", "strict", "binary", 3), ("m", "late", "binary", 4)], "generator string, judge string, judge_mode string, n long")
    rows, merged = pipelines.extra_judge(spark, both, made, ("bm25", "neural"), answers.stub_judge, "strict", "binary", str(tmp_path / "more"), old, (["m"], ["strict", "late"]))
    assert rows.count() == 40 and [(r.judge, r.n) for r in merged.collect()] == [("strict", 20), ("late", 4)]
    bad = checks.matrix(both, made, judged.where("query_id <> 'q3'"), ["m"], ["strict"], "other").where("n_violations > 0").collect()
    assert {(r.check, r.n_violations) for r in bad} == {("prompt_version", 40), ("missing_judgment", 2)}


def test_arm_matrix(spark, work, tmp_path):
    q = work.withColumn("source_row", F.regexp_extract("query_id", r"\d+", 0).cast("long"))
    sets = {d: (q, q.select("source_row", "question", "context")) for d in ("one", "two")}
    run = lambda s: pipelines.arm_matrix(spark, s, "embedding", {"m": answers.stub_writer}, {"scale": (answers.stub_judge, "scale-1-5")}, "v", str(tmp_path))
    made, judged, summary = run(sets)
    assert made.count() == judged.count() == 40 and {(r.dataset, r.arm, r.n_rows) for r in summary.collect()} == {("one", "embedding", 20), ("two", "embedding", 20)}
    with pytest.raises(checks.CheckFailed, match="two: order"):
        run({"two": (q, sets["two"][1].where("source_row <> 4"))})


def test_json_lists_and_joins(spark):
    from quillon.functions import text as T
    from quillon.operators import assemble

    texts = [["a", 'q"\\/', "\n\t"], ["é", "\U0001f600 x", "[b]"], []]
    df = spark.createDataFrame([(t,) for t in texts], "v array<string>").select("v", T.json_list(F.col("v")).alias("a"), T.json_list(F.col("v"), ascii_only=True).alias("b"))
    assert all(r.a == json.dumps(r.v, ensure_ascii=False) and r.b == json.dumps(r.v) for r in df.collect())
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    assert assemble.differing(assemble.matched(a, a, ["k"]), ["v"]).count() == 0
    with pytest.raises(checks.CheckFailed, match="unique_k"):
        assemble.matched(a, a.union(a), ["k"])
