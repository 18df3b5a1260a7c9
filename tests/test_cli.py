import json

from pyspark.sql import functions as F

from quillon.__main__ import main
from quillon.operators import columns
from quillon.plans import fixtures, pipelines

SF = "/root/testdata/sf0.001"


def test_commands(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    q = fixtures.questions(spark, SF).where("source_row < 6")
    q.write.parquet(at("q"))
    fixtures.units_document(spark, SF).write.parquet(at("u"))
    assert main(["bm25", at("q"), at("u"), at("run")]) == 0
    assert main(["check", at("run"), at("q"), at("u")]) == 0
    spark.read.parquet(at("run")).limit(3).write.parquet(at("part"))
    assert main(["check", at("part"), at("q"), at("u")]) == 1
    spark.read.parquet(at("run")).select("query_id", F.explode("retrieved_items").alias("i")).where("i.rank = 1").select("query_id", "i.unit_id").write.parquet(at("qrels"))
    assert main(["score", at("q"), at("u"), at("qrels"), at("out"), at("run")]) == 0
    assert '"recall": 1.0' in (tmp_path / "out" / "rates.json").read_text() and (tmp_path / "out" / "curve.csv").exists()
    assert main(["manifest", at("out")]) == 0


def test_external_and_windows(spark, tmp_path):
    from quillon.plans.answers import Reply

    q = fixtures.questions(spark, SF).where("source_row < 4")

    def search(request):
        if "x" * 5 in request:
            raise ValueError("no")
        return Reply('[{"rank": 1, "unit_id": "u", "doc_id": "d", "text": "t", "score": 0.5}]')

    rows = pipelines.retrieve_external(q, search, "remote").collect()
    assert all(r.retrieved_count == 1 and r.retrieval_error == "" and r.retrieved_items[0].unit_id == "u" for r in rows) and len(rows) == 4
    def windowed(request):
        r = json.loads(request)
        if "source" in r or (r["limit"], r["context"], r["level"], r["weight"]) != (2, 2, "sentence", 0.3):
            raise ValueError(request)
        unit = lambda i: {"unit_id": f"d|0|{i}", "text": f"s{i}."}
        return Reply([json.dumps([{"doc_id": "d", "paragraph_idx": 0, "subparagraph_idx": 3, "text": "s3.", "score": 0.5, "context": [unit(i) for i in range(1, 6)]}, {"doc_id": "d", "text": "s5.", "unit_id": "d|0|5", "context": [unit(i) for i in range(3, 8)]}, {"doc_id": "d", "unit_id": "beyond", "text": "x"}])])

    rows = pipelines.retrieve_windows(q, windowed, "remote", limit=2, level="sentence", weight=0.3).collect()
    assert len(rows) == 4 and all((r.retrieval_error, r.retrieved_count, r.level, r.top_k) == ("", 2, "sentence", 2) for r in rows)
    assert rows[0].retrieved_context == "s1.s2.s3.s4.s5.\n\ns6.s7." and rows[0].retrieved_items[0].unit_id == "d|0|3"
    failed = pipelines.retrieve_windows(q, windowed, "remote", limit=3, level="sentence", weight=0.3).first()
    assert failed.retrieval_error.startswith("ValueError") and failed.retrieved_count == 0 and failed.retrieved_context == ""
    sentences = spark.createDataFrame([("d", i, i, 0, f"s{i}") for i in range(9)], "doc_id string, sentence_ordinal long, paragraph_idx long, sentence_idx long, text string")
    anchors = spark.createDataFrame([("bench-000000", k, "d", p, 0) for k, p in ((1, 7), (2, 0), (3, 4), (4, 8))], "query_id string, rank int, doc_id string, paragraph_idx long, sentence_idx long")
    ranked, source, audit = pipelines.window_inputs(q.select("query_id", "question"), anchors, sentences)
    assert ranked.first().context == "s5 s6 s7 s8\n\ns0 s1 s2\n\ns3 s4" and source.first().context == "s0 s1 s2 s3 s4 s5 s6 s7 s8"
    assert audit.first().mean_sentences == 9 and audit.first().n_identical == 0


def test_columns(spark):
    df = spark.createDataFrame([("q", "bm25_old", "A", "", " ", "b", 3, "")], "query_id string, retrieval_method string, dataset string, excerpt_1 string, excerpt_2 string, excerpt_3 string, paragraph_idx int, unit_id string").withColumn("doc_id", F.lit("d"))
    r = df.select(columns.context_of(df).alias("c"), columns.excerpt_unit_id(df).alias("u")).first()
    assert (r.c, r.u) == ("b", "d|3")
    assert columns.without(df, ("dataset",), ("excerpt_",)).columns == ["query_id", "retrieval_method", "paragraph_idx", "unit_id", "doc_id"]
    assert columns.method_rows(df, "bm25", {"bm25": ("bm25_old",)}).first().retrieval_method == "bm25"
    assert columns.of_dataset(df, "a").count() == 1 and columns.named(df, "excerpt", "_", "1") == ["excerpt_1"]
    assert columns.reordered(df, ["doc"], {"doc_id": "doc"}).columns[0] == "doc" and columns.present(df, ["nope", "doc_id"]).columns == ["doc_id"]
    assert columns.sorted_by(df, ["nope", "query_id"]).count() == 1


def test_preparation_and_import(spark, tmp_path):
    import zipfile

    import pandas as pd

    queries = spark.createDataFrame([("q1", "dev", 0), ("q2", "test", 1)], "query_id string, split string, source_row long")
    sources = spark.createDataFrame([("q1", "A?", "a", 7), ("q2", "B?", "b", 8)], "query_id string, question string, golden_answer string, extra int")
    allowed = spark.createDataFrame([("q1", 2, "d1"), ("q1", 1, "d2"), ("q1", 3, "d2")], "query_id string, ord int, doc_id string")
    q = pipelines.prepare_questions(queries, sources, allowed, "set")
    assert q.columns[-1] == "extra" and {r.query_id: r.allowed_doc_ids for r in q.collect()} == {"q1": ["d2", "d1"], "q2": None}
    source = spark.createDataFrame([(0, "A?"), (5, "b ?")], "source_row long, question string")
    evidence = spark.createDataFrame([(0, "http://x/u1/", "e2", 2), (0, "http://x/u1", "e1", 1), (5, "u9", "e", 1)], "source_row long, unit_url string, evidence string, ord int")
    got = {(r.query_id, r.unit_id): (r.evidence, r.evidence_count) for r in pipelines.positional_qrels(q, source, evidence).collect()}
    assert got == {("q1", "u1"): ("e1", 2), ("q2", "u9"): ("e", 1)}
    pd.DataFrame({"n": [2, 1], "dataset": ["s", "s"], "question": ["B", "A"], "golden_answer": ["b", "a"], "near": ["x\n...\ny", "z"]}).to_parquet(tmp_path / "m.parquet")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "m.parquet", "m.parquet")
    rows = {r.query_id: r.retrieved_count for r in pipelines.import_neural(spark, str(tmp_path / "z.zip"), {"m.parquet": "parquet"}, {"e5": "near"}, "n").collect()}
    assert rows == {"s-000000": 1, "s-000001": 2}


def test_assembled_results(spark):
    base = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    g = spark.createDataFrame([("q1", "M 1", "yes", ""), ("q2", "M 1", "no", "")], "query_id string, model string, generated_answer string, generation_error string")
    j = spark.createDataFrame([("q1", "J", "CORRECT", 5, "r")], "query_id string, judge_model string, verdict string, score int, reason string")
    r = {x.query_id: x for x in pipelines.wide_result(base, g, j, ["m_1"], ["j"]).collect()}
    assert (r["q1"]["generation_m_1__generated_answer"], r["q1"]["judgment_j__score"], r["q2"]["judgment_j__verdict"]) == ("yes", 5, None)
    summary = spark.createDataFrame([("g", "j", "a", 0.5, 3.0), ("g", "j", "b", 0.25, None)], "generator string, judge string, arm string, accuracy double, mean_score double")
    got = {x.metric: (x.a, x.b, x.c) for x in pipelines.published_metrics(summary, ["a", "b", "c"]).collect()}
    assert got == {"accuracy": (0.5, 0.25, None), "mean_score": (3.0, None, None)}
    long = spark.createDataFrame([(f"q{i}", arm, i % 5 + 1 - (arm == "b") * (i % 2)) for i in range(10) for arm in "ab"], "query_id string, arm string, score int")
    assert pipelines.paired_summary(long, "a", "b", "score", False).first().wins == 5
    assert pipelines.run_matrix({"x": lambda: 1, "y": lambda: 2}) == {"x": 1, "y": 2}


def test_evaluation_commands(spark, tmp_path):
    import json

    from quillon.sources import tables

    at = lambda name: str(tmp_path / name)
    read = spark.read.parquet
    spark.createDataFrame([(f"q{i}", "dev", i) for i in range(6)], "query_id string, split string, source_row long").write.parquet(at("queries"))
    spark.createDataFrame([(f"q{i}", f"question {i}?", f"a{i}") for i in range(6)], "query_id string, question string, golden_answer string").write.parquet(at("sources"))
    spark.createDataFrame([(f"q{i}", 0, "d1") for i in range(6)], "query_id string, ord int, doc_id string").write.parquet(at("allowed"))
    assert main(["prepare", at("queries"), at("sources"), at("allowed"), "set", at("q")]) == 0
    spark.createDataFrame([("d1", 3, "text")], "doc_id string, paragraph_idx int, text string").write.parquet(at("docs"))
    assert main(["units", at("docs"), "paragraph", at("u"), "doc_id", "paragraph_idx"]) == 0 and read(at("u")).first().unit_id == "d1|3"
    spark.createDataFrame([(i, f"question {i}?") for i in range(6)], "source_row long, question string").write.parquet(at("source"))
    spark.createDataFrame([(0, "http://x/u1", "e", 1)], "source_row long, unit_url string, evidence string, ord int").write.parquet(at("evidence"))
    assert main(["qrels", at("q"), at("source"), at("evidence"), at("qrels")]) == 0 and read(at("qrels")).first().unit_id == "u1"
    q = read(at("q"))
    work = q.select("query_id", "question", "golden_answer", F.lit("bm25").alias("arm"), F.concat(F.lit("context of "), "question").alias("context"))
    work.union(work.withColumn("arm", F.lit("neural"))).write.parquet(at("work"))
    assert main(["generate", at("work"), "stub_writer", "m", "v", at("g")]) == 0 and read(at("g")).count() == 12
    assert main(["follow", at("work"), "stub_writer", "m", "v", at("f"), "--rows", "12", "--seconds", "120"]) == 0
    assert {r.generated_answer for r in read(at("f")).collect()} == {r.generated_answer for r in read(at("g")).collect()} and read(at("f")).where("attempts = 1 AND generation_error = ''").count() == 12
    assert main(["judge", at("work"), at("g"), "quillon.plans.answers:stub_judge", "j", at("j"), "--mode", "scale-1-5"]) == 0
    assert sum(r["n_rows"] for r in json.loads((tmp_path / "j-summary.json").read_text())) == 12
    summary = tables.json_documents(spark, at("j-summary.json"), "arm string, n_rows long")
    assert {(r.arm, r.n_rows) for r in summary.collect()} == {("bm25", 6), ("neural", 6)}
    one = lambda name: read(at(name)).where("arm = 'bm25'").write.parquet(at(f"{name}1"))
    one("g"), one("j")
    assert main(["wide", at("q"), at("g1"), at("j1"), at("wide")]) == 0 and "judgment_j__score" in read(at("wide")).columns
    read(at("j")).groupBy("arm").agg(F.avg("score").alias("mean_score"), F.lit(0.5).alias("accuracy")).withColumn("judge", F.lit("j")).write.parquet(at("summary"))
    assert main(["metrics", at("summary"), at("cells"), "bm25", "neural"]) == 0 and len(json.loads((tmp_path / "cells.json").read_text())) == 2
    assert main(["matrix", at("work"), "bm25", "neural", "v", at("m"), "--writer", "w=stub_writer", "--judge", "b=stub_judge=binary", "--judge", "s=stub_judge=scale-1-5"]) == 0
    assert {r["judge"] for r in json.loads((tmp_path / "m" / "paired.json").read_text())} == {"b", "s"} and json.loads((tmp_path / "m" / "provenance.json").read_text())["arms"] == ["bm25", "neural"]
    frozen = q.withColumns({"retrieval_method": F.lit("bm25"), "retrieved_context": F.lit("c"), "retrieval_error": F.lit("")})
    frozen.write.parquet(at("frozen"))
    assert main(["pilot", at("frozen"), "bm25", at("pilot"), "--size", "4"]) == 0 and read(at("pilot")).count() == 4
