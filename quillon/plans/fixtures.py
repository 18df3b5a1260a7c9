"""The evaluation tables of the registered queries, as functions of the driver's tables.

``benchmark`` passages are the questions and their own gold answers; a question allows the documents of one
source and those that hold its passage. Two BM25 arms and judgments derived from them
stand for retrieval runs and judges.

Texts are tokenized once a session: the normalized units, the questions, the rankings and the nested results are
written tables that all queries read.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import metrics, ranking, substring
from quillon.sources import scratch
from quillon.sources.tables import table

ARMS = {"bm25": 0.75, "bm25_flat": 0.0}


def once(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scratch.written(spark, (f.__module__, f.__name__, sf_dir), lambda: f(spark, sf_dir))

    return read


def units_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select(F.lit("document").alias("retrieval_level"), F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("unit_id"), "text")


def units_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    lines = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("paragraph_idx", "text")).where(~T.is_blank(F.col("text")))
    return lines.select(F.lit("paragraph").alias("retrieval_level"), "doc_id", "paragraph_idx", T.compound_id(F.col("doc_id"), F.col("paragraph_idx")).alias("unit_id"), "text")


@once
def words_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, doc_id, source, norm, length) of the documents as units."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return ranking.worded(docs.select(F.col("doc_id").cast("string").alias("unit_id"), F.col("doc_id").cast("string").alias("doc_id"), "source", "text"))


@once
def words_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, doc_id, paragraph_idx, norm, length) of the paragraphs as units."""
    return ranking.worded(units_paragraph(spark, sf_dir).select("unit_id", "doc_id", "paragraph_idx", "text"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs as sentences; their index stands for the ordinal, which need not be dense, so that nothing is put in order here."""
    return units_paragraph(spark, sf_dir).select("doc_id", F.col("paragraph_idx").alias("sentence_ordinal"), "paragraph_idx", F.lit(0).alias("sentence_idx"), "text")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions without what they allow."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return items.select(T.padded_id(F.lit("bench"), F.col("item_id")).alias("query_id"), F.when(F.col("item_id") % 10 < 7, "dev").otherwise("test").alias("split"), F.col("item_id").alias("source_row"), F.col("text").alias("question"), F.col("text").alias("golden_answer"), F.lit("bench").alias("dataset"))


@once
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages, with the allowed documents in the order of their ids as text: those of a source, and those that hold the passage at token borders."""
    q = passages(spark, sf_dir).withColumn("t", T.tokens(F.col("question")))
    docs = words_document(spark, sf_dir)
    bucket = q.select("query_id", F.concat(F.lit("src"), F.col("source_row") % 20).alias("source")).join(docs.select("doc_id", "source"), "source").select("query_id", "doc_id")
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    needles = q.where(F.size("t") >= 4).select(F.col("query_id").alias("needle_id"), F.array_join("t", " ").alias("needle"))
    held = scratch.kept(substring.candidates(needles, docs.select(F.col("doc_id").alias("text_id"), F.col("norm").alias("text")), keep=scratch.kept))  # few, so no text is shuffled
    held = docs.select(F.col("doc_id").alias("text_id"), "norm").join(held, "text_id").join(needles, "needle_id")
    held = held.where(F.contains(spaced("norm"), spaced("needle"))).select(F.col("needle_id").alias("query_id"), F.col("text_id").alias("doc_id"))
    allowed = bucket.union(held).groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("allowed_doc_ids"))
    return q.drop("t").join(allowed, "query_id", "left").withColumn("allowed_doc_ids", F.coalesce("allowed_doc_ids", F.array().cast("array<string>")))


@once
def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, arm, rank, unit_id, doc_id, score) of both arms, from one set of postings."""
    return ranking.bm25_arms(questions(spark, sf_dir), words_document(spark, sf_dir), ARMS, keep=scratch.kept)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings(spark, sf_dir).where("arm = 'bm25'").drop("arm")


@once
def paragraphs_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best paragraphs of all documents that a question allows."""
    return ranking.bm25_arms(questions(spark, sf_dir), words_paragraph(spark, sf_dir), {"bm25": 0.75}, keep=scratch.kept).drop("arm")


@once
def paragraphs_of_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best paragraphs of each question's best document: windows have the anchors of one document.

    Paragraphs are counted as they are read: of all but a few documents only the statistics are of use, so none is written.
    """
    top = ranked(spark, sf_dir).where("rank = 1").select("query_id", F.array("doc_id").alias("allowed_doc_ids"))
    return ranking.bm25_arms(passages(spark, sf_dir).join(top, "query_id"), units_paragraph(spark, sf_dir).select("unit_id", "doc_id", "text"), {"bm25": 0.75}, keep=scratch.kept).drop("arm")


@once
def all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what a question allows grows with the corpus and stays in the table of questions
    q, top = questions(spark, sf_dir).drop("allowed_doc_ids"), ranking.with_text(rankings(spark, sf_dir), units_document(spark, sf_dir))
    parts = [ranking.nested(q, top.where(F.col("arm") == arm).drop("arm"), arm, bm25_k1=1.2, bm25_b=b, top_k=4) for arm, b in ARMS.items()]
    return parts[0].unionByName(parts[1]).repartition(spark.sparkContext.defaultParallelism, "query_id", "arm")  # few rows, long texts


def results(spark: SparkSession, sf_dir: str, *arms: str) -> DataFrame:
    """One row per question and arm with nested items."""
    out = all_results(spark, sf_dir)
    return out.where(F.col("arm").isin(*arms)) if arms else out


@once
def all_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.containment(results(spark, sf_dir)).select("query_id", "arm", "source_row", "split", *[f"exact_{k}" for k in range(1, 5)])


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_flags(spark, sf_dir)


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary and a 1-5 judge derived from the flags, with refusals and failures by source_row."""
    f = flags(spark, sf_dir)
    hits = sum((F.col(f"exact_{k}").cast("int") for k in range(1, 5)), F.lit(1))
    failed, refused = F.col("source_row") % 19 == 0, F.col("source_row") % 17 == 0
    return f.select(
        "query_id", "arm", "source_row", F.when(failed, "").when(F.col("exact_4"), "CORRECT").otherwise("INCORRECT").alias("verdict"), F.when(~(failed | refused), hits).alias("score"),
        F.when(failed, "failed").otherwise("").alias("judge_error"), F.when(refused & ~failed, "content_filter").otherwise("").alias("judge_fallback"), (F.col("source_row") + 100).alias("judge_total_tokens"),
    )


@once
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best paragraphs, four at most, of each question's best document."""
    best = paragraphs_of_best(spark, sf_dir)
    return best.select("query_id", "rank", "doc_id", F.substring_index("unit_id", "|", -1).cast("int").alias("paragraph_idx"), F.lit(0).alias("sentence_idx"))


# services over the driver's tables, which stand for remote ones ------------------------------------------


def database(address: str):
    """A DB-API connection to a database that has the documents as units."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})  # one of several in an executor
    source = f"{address}/documents.parquet"
    found = f"read_parquet('{source}/*.parquet')" if os.path.isdir(source) else f"read_parquet('{source}')"
    con.execute(f"CREATE VIEW units AS SELECT 'document' AS retrieval_level, CAST(doc_id AS VARCHAR) AS doc_id, CAST(doc_id AS VARCHAR) AS unit_id, doc_id AS doc_key, text FROM {found}")
    return con


def search(request: dict, address: str) -> list[dict]:
    """The allowed documents that hold the most of a question's words, equal ones by their id."""
    words = sorted(set(re.findall("[a-z]+", request["query"].lower())))
    con = database(address)
    try:
        rows = con.execute("SELECT doc_id, text, len(list_filter(?::VARCHAR[], lambda w: contains(lower(text), w))) AS score FROM units WHERE doc_id IN (SELECT unnest(?::VARCHAR[])) ORDER BY score DESC, doc_id LIMIT ?", [words, request["allowed_doc_ids"], request["limit"]]).fetchall()
    finally:
        con.close()
    return [{"doc_id": d, "text": t, "score": float(s)} for d, t, s in rows]


def archive_of_names(spark: SparkSession, sf_dir: str) -> str:
    """A zip file with the customers as Parquet and the suppliers as compressed CSV."""
    root = scratch.root(spark).removeprefix("file:").replace("//", "/")
    made = {
        "customer.parquet": table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        "supplier.csv.gz": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name")),
    }
    path = f"{root}/quillon-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in made.items():
            part = f"{root}/quillon-{uuid.uuid4().hex}"
            one = df.coalesce(1).write
            one.parquet(part) if name.endswith("parquet") else one.option("header", True).option("compression", "gzip").csv(part)
            [found] = [f for f in os.listdir(part) if f.startswith("part-")]
            z.write(f"{part}/{found}", f"data/{name}")
    return path
