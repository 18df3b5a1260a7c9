"""Reports that read each table once, and runs that are checked as they are written."""

import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import checks
from quillon.plans import pipelines


def report(df):
    return {r.check: r.n_violations for r in df.collect()}


def test_multiset_difference(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (3, "z")], "k int, v string")
    assert report(checks.equal_sets("same", a, b)) == {"same": a.exceptAll(b).count() + b.exceptAll(a).count()} == {"same": 4}
    assert report(checks.equal_sets("same", a, a)) == {"same": 0} and report(checks.equal_sets("same", a.limit(0), b.limit(0))) == {"same": 0}


def scans(df, capsys):
    df.explain("formatted")
    return len(re.findall(r"(?m)^\(\d+\) Scan parquet", capsys.readouterr().out))


def test_a_package_reads_each_table_once(spark, tmp_path, capsys):
    items = F.expr("array(named_struct('rank', 1, 'text', 't'))")
    for i, arm in enumerate("abc"):
        rows = spark.range(20 + i).select(F.col("id").cast("string").alias("query_id"), F.lit(arm).alias("arm"), F.lit("q").alias("question"), F.lit("").alias("retrieval_error"), items.alias("retrieved_items"), F.lit("CORRECT").alias("j__verdict"))
        rows.write.parquet(str(tmp_path / arm))
    tables = {arm: spark.read.parquet(str(tmp_path / arm)) for arm in "abc"}
    df = checks.package(tables, {"a": 20, "b": 21, "c": 23})
    got = report(df)
    assert got["b: questions"] == 1 and got["c: questions"] == 2 and got["c: rows"] == 1 and got["b: rows"] == 0 and sum(got.values()) == 4
    assert scans(df, capsys) == 3


def test_a_handoff_report(spark, capsys, tmp_path):
    q = spark.createDataFrame([(f"q{i}", ["d"]) for i in range(6)], "query_id string, allowed_doc_ids array<string>")
    units = spark.createDataFrame([("u", "d"), ("v", "e")], "unit_id string, doc_id string")
    rows = [(f"q{i}", arm, "x", "g", "", 1, [("u", "d", "t")]) for i in range(6) for arm in "ab"]
    rows += [("q1", "a", "x", "g", "", 1, [("u", "d", "t")]), ("q9", "a", None, "g", "", 2, [("v", "e", "t")]), ("q2", "z", "x", "g", "", 1, [("w", "d", "t")])]
    rows = [r for r in rows if r[:2] != ("q5", "b")]
    df = spark.createDataFrame(rows, "query_id string, arm string, question string, golden_answer string, retrieval_error string, retrieved_count int, retrieved_items array<struct<unit_id:string,doc_id:string,text:string>>")
    got = report(checks.handoff(df, q, units, ["a", "b", "c"]))
    assert {k: v for k, v in got.items() if v} == {"arms": 2, "row_count": 1, "unique_query_id_arm": 1, "missing_key": 7, "unknown_key": 2, "null_question": 1, "count_differs": 1, "known_unit": 1, "allowed_document": 1}


def test_a_run_is_checked_as_it_is_written(spark, tmp_path):
    q = spark.createDataFrame([("q1", "alpha", "g", ["d"]), ("q2", "beta", "g", ["d"])], "query_id string, question string, golden_answer string, allowed_doc_ids array<string>")
    units = spark.createDataFrame([("u", "d", "alpha beta")], "unit_id string, doc_id string, text string")
    run = pipelines.retrieve(q, units)
    pipelines.write_run(run, str(tmp_path / "good"), 2)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    faults = {"rows": run.limit(1), "null_answer": run.withColumn("golden_answer", F.lit(None).cast("string")), "error": run.withColumn("retrieval_error", F.lit("x")), "repeated_key": run.withColumn("query_id", F.lit("q1")), "null_key": run.withColumn("query_id", F.lit(None).cast("string")), "count_differs": run.withColumn("retrieved_count", F.lit(3))}
    for name, bad in faults.items():
        with pytest.raises(checks.CheckFailed, match=name):
            pipelines.write_run(bad, str(tmp_path / name), 2)
        assert not (tmp_path / name).exists()
