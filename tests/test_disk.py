"""What rankings and joins by containment write and shuffle."""

import random

from pyspark.sql import functions as F

from quillon.operators import metrics, ranking, substring
from quillon.plans import fixtures
from quillon.sources import scratch


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_allowed_ranking_keeps_no_postings(spark):
    """What is written grows with the questions and the documents they allow, not with the postings of all units."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = [(f"u{i}", f"d{i // 4}", " ".join(rng.choices(words, k=40))) for i in range(800)]
    units = ranking.worded(spark.createDataFrame(rows, "unit_id string, doc_id string, text string"))
    asked = spark.createDataFrame([("q", " ".join(words[:60]), ["d7", "d9"])], "query_id string, question string, allowed_doc_ids array<string>")
    kept = []
    got = ranking.bm25_arms(asked, units, {"a": 0.75}, keep=lambda df: kept.append(df.count()) or df).collect()
    assert {r.doc_id for r in got} <= {"d7", "d9"} and [r.rank for r in got] == [1, 2, 3, 4]
    assert max(kept) <= 60  # the question's tokens; all units have some 9,000 postings of these


def test_few_and_many_allowed_documents_rank_alike(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    units = spark.createDataFrame([(f"u{i:03d}", f"d{i % 30}", " ".join(rng.choices(words, k=rng.randint(0, 20)))) for i in range(300)], "unit_id string, doc_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=5)), [f"d{k}" for k in rng.sample(range(30), 9)]) for i in range(6)], "query_id string, question string, allowed_doc_ids array<string>")
    ranks = lambda: sorted((r.query_id, r.rank, r.unit_id, round(r.score, 9)) for r in ranking.bm25(asked, units).collect())
    few = ranks()
    monkeypatch.setattr(ranking, "FEW", 3)
    assert len(few) == 24 and ranks() == few


def test_texts_of_units_that_are_not_ranked_go_before_the_join(spark):
    units = spark.range(50).select(F.col("id").cast("string").alias("unit_id"), F.lit("x").alias("text"))
    ranked = spark.createDataFrame([("q", "3"), ("q", "nowhere")], "query_id string, unit_id string")
    df = ranking.with_text(ranked, units)
    assert "LeftSemi" in plan(df) and {(r.unit_id, r.text) for r in df.collect()} == {("3", "x"), ("nowhere", None)}


def test_sentences_need_no_order(spark, tmp_path):
    spark.createDataFrame([(1, "a\n\nb\nc"), (2, "d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = fixtures.sentences(spark, str(tmp_path))
    assert "Window" not in plan(df) and sorted((r.doc_id, r.sentence_ordinal, r.text) for r in df.collect()) == [("1", 0, "a"), ("1", 2, "b"), ("1", 3, "c"), ("2", 0, "d")]


def test_qrels_write_their_pairs(spark):
    """The pairs that keys find are written, so that the join for the texts can see how few they are."""
    units = spark.createDataFrame([(f"u{i}", f"d{i}", f"some text of number{i} and more words") for i in range(40)], "unit_id string, doc_id string, text string")
    asked = spark.createDataFrame([("q", "text of number7 and", ["d7", "d8"])], "query_id string, golden_answer string, allowed_doc_ids array<string>")
    kept = []
    got = metrics.substring_qrels(asked, units, keep=lambda df: kept.append(df.count()) or df).collect()
    assert [(r.query_id, r.unit_id) for r in got] == [("q", "u7")] and len(kept) == 4 and max(kept) < 40


def test_search_stays_small_beside_other_tasks(tmp_path, spark):
    """Each search task has a thread and a bound on memory of its own, not the machine's."""
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = fixtures.database(str(tmp_path))
    assert con.execute("SELECT current_setting('threads')").fetchone() == (1,) and con.execute("SELECT current_setting('memory_limit')").fetchone()[0] == "488.2 MiB"
    con.close()


def test_counts_go_to_many_documents_and_no_text(spark, monkeypatch):
    """Units are counted below the join with the documents that questions allow, so that no text is shuffled for it."""
    monkeypatch.setattr(ranking, "FEW", 1)
    units = ranking.worded(spark.createDataFrame([(f"u{i}", f"d{i}", f"some text of number{i}") for i in range(9)], "unit_id string, doc_id string, text string"))
    asked = spark.createDataFrame([("q", "number3"), ("q", "number4")], "query_id string, token string")
    allowed = spark.createDataFrame([("q", f"d{i}") for i in range(4)], "query_id string, doc_id string")
    hits, _ = ranking.scored_where_allowed(units, asked, allowed, [0.75], 1.2, lambda df: df)
    assert plan(hits).index("strategy=shuffle_hash") < plan(hits).index("zip_with") and [r.unit_id for r in hits.collect()] == ["u3"]


def test_statistics_and_frequencies_in_one_pass(spark):
    units = ranking.worded(spark.createDataFrame([("u1", "d", "a b b"), ("u2", "d", "b c"), ("u3", "e", ""), ("u4", "e", "z z z")], "unit_id string, doc_id string, text string"))
    asked = spark.createDataFrame([("q", t) for t in "abx"] + [("r", "b")], "query_id string, token string")
    got = ranking.frequencies(ranking.tokenized(units), asked)
    assert sorted(tuple(r) for r in got.select("token", "df", "n_units", "avgdl").collect()) == [("a", 1, 4, 2.0), ("b", 2, 4, 2.0)]
    assert not ranking.frequencies(ranking.tokenized(units.where("false")), asked).collect()


def test_windows_write_no_paragraphs(spark, tmp_path):
    """Of paragraphs outside the best documents only the statistics are of use; anchors name theirs by the unit's id."""
    texts = [(i, f"first line of {i}\n\nthe answer is number{i} and more\nlast", "src1") for i in range(5)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "answer is number3 and")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = sorted((r.rank, r.doc_id, r.paragraph_idx) for r in fixtures.anchors(spark, str(tmp_path)).collect())
    assert rows == [(1, "3", 2), (2, "3", 0), (3, "3", 3)]
    assert not any("words_paragraph" in key and str(tmp_path) in key for key in scratch._WRITTEN)


def test_results_leave_allowed_documents_to_the_questions(spark, tmp_path):
    spark.createDataFrame([(i, f"text of number{i} and more", "src1") for i in range(3)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "text of number2 and")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = fixtures.results(spark, str(tmp_path))
    assert "allowed_doc_ids" not in df.columns and [(r.retrieved_items[0].doc_id, r.retrieved_count) for r in df.collect()] == [("2", 3)] * 2


def test_candidates_write_the_chosen_keys(spark):
    """The rarest key of each needle is written, so that the join can see how few these are; occurrences are combined before they are shuffled."""
    texts = spark.createDataFrame([(i, f"the same words and number{i} the same words") for i in range(30)], "text_id long, text string")
    needles = spark.createDataFrame([(1, "x the same number7 y"), (2, "words and number7 the same")], "needle_id long, needle string")
    kept = []
    pairs = substring.candidates(needles, texts, keep=lambda df: kept.append([tuple(r) for r in df.collect()]) or df)
    assert kept == [[], [(2, "and number7")]] and [tuple(r) for r in pairs.collect()] == [(2, 7)]
