"""Remote SQL, ranked search, archives and footers as data sources."""

import gzip
import json
import sqlite3
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from quillon.plans import pipelines
from quillon.sources import archives, remote


def connect(address):
    """The executors' way to the test's database, which notes every statement."""
    con = sqlite3.connect(address)
    notes = open(address + ".log", "a", buffering=1)

    class Cursor:
        def __init__(self):
            self.inner = con.cursor()

        def execute(self, statement, values):
            notes.write(json.dumps([statement, list(values)]) + "\n")
            self.inner.execute(statement, values)

        def fetchmany(self, n):
            return self.inner.fetchmany(n)

    class Connection:
        cursor = staticmethod(Cursor)
        close = staticmethod(con.close)

    return Connection()


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "units.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE units (retrieval_level TEXT, doc_id TEXT, unit_id TEXT, text TEXT, number INTEGER)")
    rows = [("paragraph" if i % 3 else "document", f"d'{i // 3}", f"u{i}", None if i == 7 else f"text {i}", i if i else None) for i in range(3000)]
    con.executemany("INSERT INTO units VALUES (?, ?, ?, ?, ?)", rows)
    con.commit()
    con.close()
    return path, rows


def statements(path):
    return [json.loads(line) for line in open(path + ".log")]


CONNECT = "tests.test_sources:connect"


def test_filters_and_columns_go_to_the_database(spark, database, capsys):
    path, rows = database
    df = remote.sql_units(spark, CONNECT, path, "paragraph", [f"d'{i}" for i in range(700)])
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [" in plan and "EqualTo(retrieval_level,paragraph)" in plan and "In(doc_id" in plan and "Filter (" not in plan
    got = sorted(map(tuple, df.collect()))
    assert got == sorted((d, u, t) for level, d, u, t, _ in rows if level == "paragraph" and int(d[2:]) < 700)
    sent = statements(path)
    assert sorted(len(v) for _, v in sent) == [201, 501]  # 700 ids in two statements, and the level
    assert all("paragraph" in v and "d'" not in s and '"number"' not in s and s.count("?") == len(v) for s, v in sent)


def test_parts_by_a_number(spark, database):
    path, rows = database
    df = remote.sql_table(spark, CONNECT, path, "units", "unit_id string, number long", partitionColumn="number", numPartitions=5)
    assert sorted(r.unit_id for r in df.where("number IS NULL OR number >= 10").collect()) == sorted(r[2] for r in rows if r[4] is None or r[4] >= 10)
    assert df.rdd.getNumPartitions() == 5 and df.where(F.col("number") < 4).count() == 3 and df.where(~F.col("unit_id").isin("u1", "u2")).count() == 2998


def test_conditions_bind_their_values():
    assert remote.condition(ds.EqualTo(("a",), "x'; --")) == ('"a" = ?', ("x'; --",))
    assert remote.condition(ds.Not(ds.In(('q"',), (1, 2)))) == ('NOT ("q""" IN (?, ?))', (1, 2))
    assert remote.condition(ds.IsNull(("a",))) == ('"a" IS NULL', ()) and remote.condition(ds.IsNotNull(("a",))) == ('"a" IS NOT NULL', ())
    assert remote.condition(ds.LessThanOrEqual(("a",), 3)) == ('"a" <= ?', (3,))
    assert remote.condition(ds.StringContains(("a",), "x")) is None and remote.condition(ds.EqualTo(("a", "b"), 1)) is None


def search(request, address):
    """Hits named after the question, as many as asked for; notes each request; one question fails."""
    with open(address, "a") as f:
        f.write(json.dumps(request) + "\n")
    if request["query"] == "question 3":
        raise ConnectionError("gone")
    return [{"doc_id": d, "text": f"{request['query']} {d}", "score": 1.0 / (i + 1), "paragraph_idx": 2 * i, "context": [{"unit_id": "x", "text": "y"}]} for i, d in enumerate(request["allowed_doc_ids"])]


def asked(spark, path, ids):
    rows = [(f"q{i:03d}", f"question {i}", [f"d{k}" for k in range(i % 7)]) for i in ids]
    spark.createDataFrame(rows, "query_id string, question string, allowed_doc_ids array<string>").write.mode("append").parquet(path)
    return rows


def wanted(rows, limit):
    return sorted((q, k + 1, f"{d}|{2 * k}", d) for q, text, docs in rows if text != "question 3" for k, d in enumerate(docs[:limit]))


def test_search_as_a_table(spark, tmp_path):
    path, log = str(tmp_path / "q"), str(tmp_path / "log")
    rows = asked(spark, path, range(40))
    hits = remote.search_hits(spark, path, "tests.test_sources:search", log, limit=3, page=7, level="paragraph", weight=0.5)
    assert hits.rdd.getNumPartitions() == 6
    got = hits.collect()
    assert sorted((r.query_id, r["rank"], r.unit_id, r.doc_id) for r in got if not r.retrieval_error) == wanted(rows, 3)
    assert [(r.query_id, r.retrieval_error) for r in got if r.retrieval_error] == [("q003", "ConnectionError: gone")]
    requests = [json.loads(line) for line in open(log)]
    assert all(r["limit"] == 3 and r["level"] == "paragraph" and r["weight"] == 0.5 for r in requests)
    run = {r.query_id: r for r in pipelines.retrieve_searched(spark.read.parquet(path), hits, "found", 3, level="paragraph").collect()}
    assert len(run) == 40 and run["q003"].retrieval_error and run["q003"].retrieved_count == 0 and run["q006"].retrieved_count == 3 and run["q007"].retrieved_count == 0
    assert run["q006"].retrieved_context == "question 6 d0\n\nquestion 6 d1\n\nquestion 6 d2" and run["q006"].retrieved_items[1].paragraph_idx == 2


def test_search_as_a_stream_goes_on_after_a_restart(spark, tmp_path):
    path, log, out, state = (str(tmp_path / n) for n in ("q", "log", "out", "state"))

    def run():
        stream = remote.search_hits(spark, path, "tests.test_sources:search", log, limit=2, streaming=True, page=5)
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.query_id, r["rank"], r.unit_id, r.doc_id) for r in spark.read.parquet(out).where("retrieval_error = ''").collect())

    rows = asked(spark, path, range(12))
    assert run() == wanted(rows, 2)
    rows += asked(spark, path, range(12, 31))
    assert run() == wanted(rows, 2) and run() == wanted(rows, 2)
    sent = [json.loads(line)["query"] for line in open(log)]
    assert sorted(sent) == sorted(t for _, t, _ in rows)  # each question once over three runs


def test_members_of_an_archive(spark, tmp_path):
    path = str(tmp_path / "z.zip")
    pq.write_table(pa.table({"a": pa.array(range(10_000)), "b": pa.array([None, "x"] * 5000)}), tmp_path / "m", row_group_size=3000)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.write(tmp_path / "m", "in/m.parquet")
        z.writestr("n.csv", 'b,c\n"two\nlines, ""quoted""",\nplain,é\n')
        z.writestr("o.csv.gz", gzip.compress(b"c,d\n1,2\n"))
        z.writestr("empty.csv", "b,c\n")
    df = archives.archive(spark, path, {"in/m.parquet": "parquet", "n.csv": "csv", "o.csv.gz": "csv.gz", "empty.csv": "csv"})
    assert df.columns == ["a", "b", "c", "d"] and df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert [r.a for r in rows[:10_000]] == list(range(10_000)) and {r.b for r in rows[:10_000]} == {None, "x"}
    assert [tuple(r) for r in rows[10_000:]] == [(None, 'two\nlines, "quoted"', "", None), (None, "plain", "é", None), (None, None, "1", "2")]
    few = archives.archive(spark, path, {"in/m.parquet": "parquet", "n.csv": "csv"}, ["b"])
    assert few.columns == ["b"] and few.count() == 10_002


def test_footers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for k in range(30):
        pq.write_table(pa.table({"a": pa.array([k, None, k + 1]), "b": pa.array(["x"] * 3)}), tmp_path / "t" / f"{k}.parquet", row_group_size=2)
    got = archives.footers(spark, str(tmp_path / "t")).collect()
    assert len(got) == 60
    a = {r.path.rsplit("/", 1)[1]: r for r in got if r.column == "a"}
    assert all((a[f"{k}.parquet"].rows, a[f"{k}.parquet"].row_groups, a[f"{k}.parquet"].columns, a[f"{k}.parquet"].nulls, a[f"{k}.parquet"].least, a[f"{k}.parquet"].greatest) == (3, 2, 2, 1, str(k), str(k + 1)) for k in range(30))
