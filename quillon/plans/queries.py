"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.stats import sign_test
from quillon.operators import assemble, checks, columns, metrics, paired, ranking, sampling, windows
from quillon.plans import answers, fixtures, pipelines
from quillon.plans.oracle import norm, tok, with_tables
from quillon.sources import archives, remote, scratch, tables
from quillon.sources.tables import table
from quillon.streaming import attempts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_tables(sql)
        return f

    return add


# text ------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({tok('text')}) AS n_tokens, sha256({norm('text')}) AS norm_sha256, length(text) AS n_characters, strlen(text) AS n_bytes FROM documents")
def norm_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents", "doc_id", "text").withColumn("t", T.tokens(F.col("text")))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), T.sha256(F.array_join("t", " ")).alias("norm_sha256"), F.char_length("text").cast("long").alias("n_characters"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS column_slug,
 regexp_replace(regexp_replace(url, '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS file_slug, split_part(regexp_replace(url, '/+$', ''), '/', -1) AS last_segment,
 TRY_CAST(nullif(regexp_extract(url, '(\d+)$', 1), '') AS BIGINT) AS ordinal FROM pages""")
def slug_values(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages", "page_id", "url").select("page_id", T.column_slug(url).alias("column_slug"), T.file_slug(url).alias("file_slug"), T.last_segment(url).alias("last_segment"), T.trailing_ordinal(url).alias("ordinal"))


@query(r"""SELECT event_id, nullif(regexp_extract('Sure: ```json ' || coalesce(props, '') || ' ``` done', '(?s)\{.*\}'), '') AS body, sha256(coalesce(props, '')) AS props_sha256 FROM events""")
def json_object_extract(spark: SparkSession, sf: str) -> DataFrame:
    props = F.coalesce(F.col("props"), F.lit(""))
    return table(spark, sf, "events", "event_id", "props").select("event_id", T.json_object(F.concat(F.lit("Sure: ```json "), props, F.lit(" ``` done"))).alias("body"), T.sha256(F.col("props")).alias("props_sha256"))


#: What follows the planted labels, by (conv_id + turn) modulo their number; the last three don't end a label.
_CLOSERS = [" ", "\n", ":", ".", ",", ";", "!", "?", ")", "]", "}", "'", '"', "-", "—", "", "s", "/", "–"]
_ENDS = T.LABEL_ENDS.replace("'", "''")
_CLOSER = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in _CLOSERS) + f"][1 + (conv_id + turn) % {len(_CLOSERS)}]"
_REPLIES = f"CASE turn % 4 WHEN 0 THEN ' entailment' || {_CLOSER} || CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'yes' END WHEN 1 THEN 'CONTRADICTION' WHEN 2 THEN 'True/Entailment' ELSE text END AS reply"
_LABEL = f"lower(nullif(regexp_extract(reply, '(?i)^\\s*(Entailment|Contradiction)($|[{_ENDS}])', 1), ''))"


def _replies() -> Column:
    n, turn = (F.col("conv_id") + F.col("turn")) % len(_CLOSERS), F.col("turn") % 4
    closed = F.concat(F.lit(" entailment"), F.get(F.array(*map(F.lit, _CLOSERS)), n.cast("int")), F.when(F.col("conv_id") % 2 == 0, "").otherwise("yes"))
    return F.when(turn == 0, closed).when(turn == 1, "CONTRADICTION").when(turn == 2, "True/Entailment").otherwise(F.col("text"))


@query(f"WITH c AS (SELECT conv_id, turn, {_REPLIES} FROM conversations), l AS (SELECT *, {_LABEL} AS label FROM c) SELECT conv_id, turn, upper(label[1]) || label[2:] AS label FROM l")
def label_parse(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", T.leading_label(_replies(), ("Entailment", "Contradiction")).alias("label"))


# units -----------------------------------------------------------------------------------------


@query("SELECT 'document' AS retrieval_level, doc_id, unit_id, sha256(text) AS text_sha256 FROM d")
def units_document(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.units_document(spark, sf).withColumn("text_sha256", T.sha256(F.col("text"))).drop("text")


@query("SELECT 'paragraph' AS retrieval_level, doc_id, paragraph_idx, unit_id, sha256(text) AS text_sha256 FROM para")
def units_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.units_paragraph(spark, sf).withColumn("text_sha256", T.sha256(F.col("text"))).withColumn("paragraph_idx", F.col("paragraph_idx").cast("long")).drop("text")


@query("SELECT query_id, count(*) AS n_allowed, string_agg(doc_id, ',' ORDER BY doc_id) AS allowed FROM al GROUP BY query_id")
def allowed_docs(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.questions(spark, sf).select("query_id", F.size("allowed_doc_ids").cast("long").alias("n_allowed"), F.array_join("allowed_doc_ids", ",").alias("allowed"))


# statistics and ranking --------------------------------------------------------------------------


@query("SELECT n AS n_units, round(avgdl, 6) AS avgdl FROM ba_st")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.corpus_stats(ranking.tokenized(fixtures.words_document(spark, sf))).withColumn("avgdl", F.round("avgdl", 6))


@query("SELECT token, df FROM ba_df")
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.document_frequency(ranking.tokenized(fixtures.words_document(spark, sf)))


@query("SELECT unit_id, token, tf FROM ba_po")
def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.term_frequency(ranking.tokenized(fixtures.words_document(spark, sf)))


@query("SELECT query_id, rank, unit_id, doc_id, round(score, 6) AS score FROM ba_top")
def bm25_top4_document(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.ranked(spark, sf).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT query_id, rank, unit_id, doc_id, round(score, 6) AS score FROM bp_top")
def bm25_top4_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.paragraphs_ranked(spark, sf).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


_WIDE = ", ".join(f"coalesce(max(unit_id) FILTER (rank = {k}), '') AS excerpt_{k}_unit_id, round(max(score) FILTER (rank = {k}), 6) AS excerpt_{k}_score" for k in range(1, 5))


@query(f"SELECT q.query_id, {_WIDE}, count(unit_id) AS retrieved_count FROM q LEFT JOIN ba_top USING (query_id) GROUP BY q.query_id")
def bm25_wide(spark: SparkSession, sf: str) -> DataFrame:
    df = ranking.wide(fixtures.results(spark, sf, "bm25"))
    return df.select("query_id", *[c for k in range(1, 5) for c in (F.col(f"excerpt_{k}_unit_id"), F.round(f"excerpt_{k}_score", 6).alias(f"excerpt_{k}_score"))], "retrieved_count")


@query("SELECT q.query_id, sha256(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY rank), '')) AS retrieval_context_sha256 FROM q LEFT JOIN (SELECT * FROM ba_top JOIN d USING (unit_id)) USING (query_id) GROUP BY q.query_id")
def bm25_context(spark: SparkSession, sf: str) -> DataFrame:
    df = fixtures.results(spark, sf, "bm25").withColumn("c", ranking.context())
    return sampling.context_sha(df, "c").select("query_id", "retrieval_context_sha256")


@query("SELECT query_id, rank, unit_id FROM ba_top")
def wide_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    df = ranking.from_wide(ranking.wide(fixtures.results(spark, sf, "bm25")).drop("retrieved_items"))
    return df.select("query_id", F.explode("retrieved_items").alias("i")).select("query_id", F.col("i.rank").cast("long").alias("rank"), "i.unit_id")


@query("SELECT q.query_id, " + ", ".join(f"sha256(coalesce(string_agg(text, ' ' ORDER BY rank) FILTER (rank <= {k}), '')) AS sha256_{k}" for k in range(1, 5)) + " FROM q LEFT JOIN (SELECT query_id, rank, text FROM ba_top JOIN d USING (unit_id)) USING (query_id) GROUP BY q.query_id")
def cumulative_texts(spark: SparkSession, sf: str) -> DataFrame:
    df = fixtures.results(spark, sf, "bm25").withColumn("c", ranking.cumulative())
    return df.select("query_id", *[T.sha256(F.get("c", F.lit(k - 1))).alias(f"sha256_{k}") for k in range(1, 5)])


# containment -------------------------------------------------------------------------------------


@query("SELECT query_id, arm, exact_1, exact_2, exact_3, exact_4 FROM fl")
def exact_topk_flags(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.flags(spark, sf).drop("source_row", "split")


_GRAMS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
_RELAXED = ", ".join(
    f"CASE WHEN len(qt) = 0 THEN false WHEN len(qt) = 1 THEN list_contains(string_split(coalesce(c{k}, ''), ' '), qt[1]) ELSE list_sum(list_transform(list_distinct(gg), lambda v: greatest(len(list_filter(gg, lambda y: y = v)) - len(list_filter(e{k}, lambda y: y = v)), 0))) <= 1 END AS relaxed_{k}"
    for k in range(1, 5)
)


@query(f"SELECT query_id, arm, {_RELAXED} FROM (SELECT *, {_GRAMS.format('qt')} AS gg, {', '.join(f'{_GRAMS.format(f"s{k}")} AS e{k}' for k in range(1, 5))} FROM (SELECT *, {', '.join(f"string_split(coalesce(c{k}, ''), ' ') AS s{k}" for k in range(1, 5))} FROM fl))")
def relaxed_bigram_flags(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.relaxed(fixtures.results(spark, sf))


@query("SELECT query_id, exact_full FROM fulld")
def full_doc_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.full_document(fixtures.questions(spark, sf), fixtures.words_document(spark, sf), keep=scratch.kept)


@query("SELECT arm, count(*) AS n_questions, count(*) FILTER (exact_full) AS n_ceiling, " + ", ".join(f"count(*) FILTER (exact_{k}) AS hits_{k}, round(count(*) FILTER (exact_{k}) / nullif(count(*) FILTER (exact_full), 0), 9) AS share_{k}" for k in range(1, 5)) + " FROM fl JOIN fulld USING (query_id) GROUP BY arm")
def containment_curve(spark: SparkSession, sf: str) -> DataFrame:
    full = metrics.full_document(fixtures.questions(spark, sf), fixtures.words_document(spark, sf), keep=scratch.kept)
    out = metrics.curve(fixtures.flags(spark, sf), full)
    return out.withColumns({f"share_{k}": F.round(f"share_{k}", 9) for k in range(1, 5)})


_QRELS = "SELECT al.query_id, d.unit_id, d.doc_id FROM al JOIN q USING (query_id) JOIN d USING (doc_id) WHERE len(d.t) >= 4 AND (contains(array_to_string(d.t, ' '), g) OR contains(g, array_to_string(d.t, ' ')))"


@query(f"SELECT x.*, 1 AS relevance, sha256(golden_answer) AS evidence FROM ({_QRELS}) x JOIN q USING (query_id)")
def qrels_substring(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.substring_qrels(fixtures.questions(spark, sf), fixtures.words_document(spark, sf), keep=scratch.kept)
    return out.withColumn("evidence", T.sha256(F.col("evidence")))


@query(f"""SELECT arm, k, round(sum(coalesce(f, 0) / n_gold) / count(*), 9) AS recall, round(count(f) FILTER (f > 0) / count(*), 9) AS hit, count(*) AS n_questions
 FROM (SELECT query_id, count(*) AS n_gold FROM ({_QRELS}) GROUP BY query_id) g CROSS JOIN (VALUES ('bm25'), ('bm25_flat')) a(arm) CROSS JOIN (VALUES (1), (2), (3), (4)) k(k)
 LEFT JOIN (SELECT r.arm, r.query_id, kk.k, count(*) AS f FROM ranked2 r JOIN ({_QRELS}) x ON x.query_id = r.query_id AND x.unit_id = r.unit_id JOIN (VALUES (1), (2), (3), (4)) kk(k) ON r.rank <= kk.k GROUP BY ALL) h USING (arm, k, query_id) GROUP BY arm, k""")
def recall_hit_at_k(spark: SparkSession, sf: str) -> DataFrame:
    q = fixtures.questions(spark, sf)
    qrels = metrics.substring_qrels(q, fixtures.words_document(spark, sf), keep=scratch.kept)
    return metrics.recall_hit(fixtures.rankings(spark, sf).select("query_id", "arm", "rank", "unit_id"), qrels).withColumns({"recall": F.round("recall", 9), "hit": F.round("hit", 9)})


# windows -----------------------------------------------------------------------------------------


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.expand(fixtures.anchors(spark, sf), fixtures.sentences(spark, sf))


@query("SELECT query_id, rank, doc_id, position, is_first FROM win")
def window_expand(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.col("position").cast("long").alias("position"), "is_first")


@query("SELECT query_id, count(*) FILTER (NOT is_first) AS n_dropped, count(*) FILTER (is_first) AS n_kept FROM win GROUP BY query_id")
def window_dedup_count(spark: SparkSession, sf: str) -> DataFrame:
    return windows.duplicates_dropped(_windows(spark, sf))


def _rendered(keys: str, gap: bool) -> str:
    mark = "CASE WHEN before IS NOT NULL AND before <> position - 1 THEN '[...] ' ELSE '' END || text" if gap else "text"
    return f"SELECT {keys}, sha256(string_agg({mark}, ' ' ORDER BY position)) AS window_sha256, count(*) AS n_sentences FROM (SELECT *, lag(position) OVER (PARTITION BY {keys} ORDER BY position) AS before FROM win WHERE is_first) GROUP BY {keys}"


def _hashed(df: DataFrame) -> DataFrame:
    out = df.withColumn("window_sha256", T.sha256(F.col("window_text"))).drop("window_text")
    return out.withColumn("rank", F.col("rank").cast("long")) if "rank" in out.columns else out


@query(_rendered("query_id, rank", True))
def window_render_gap(spark: SparkSession, sf: str) -> DataFrame:
    return _hashed(windows.rendered(_windows(spark, sf), by_rank=True))


@query(_rendered("query_id", True))
def window_source_order(spark: SparkSession, sf: str) -> DataFrame:
    return _hashed(windows.rendered(_windows(spark, sf), by_rank=False))


@query(_rendered("query_id, rank", False))
def window_render_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _hashed(windows.rendered(_windows(spark, sf), by_rank=True, gap=None))


# judgments -----------------------------------------------------------------------------------------

_OK = "judge_error = ''"
_SUMMARY = f"""SELECT arm, count(*) AS n_rows, count(*) FILTER (judge_error <> '') AS n_errors, count(*) FILTER (judge_fallback <> '') AS n_fallbacks,
 round(avg((verdict = 'CORRECT')::INT) FILTER ({_OK} AND verdict <> ''), 9) AS accuracy, round(avg(score) FILTER ({_OK}), 9) AS mean_score, count(score) FILTER ({_OK}) AS n_scored,
 count(*) FILTER ({_OK} AND score IS NULL) AS n_ignored, {', '.join(f"count(*) FILTER ({_OK} AND score = {k}) AS score_{k}" for k in range(1, 6))}, CAST(sum(judge_total_tokens) AS BIGINT) AS judge_total_tokens FROM """


def _summary(df: DataFrame) -> DataFrame:
    return metrics.judge_summary(df, "arm").withColumns({"accuracy": F.round("accuracy", 9), "mean_score": F.round("mean_score", 9)})


@query(_SUMMARY + "ju GROUP BY arm")
def judge_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(fixtures.judgments(spark, sf))


@query(_SUMMARY + "(SELECT * REPLACE (CASE WHEN judge_error <> '' THEN 1 ELSE score END AS score, CASE WHEN judge_error <> '' THEN 'failed_as_1' ELSE judge_fallback END AS judge_fallback, '' AS judge_error) FROM ju) GROUP BY arm")
def failure_as_one(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(metrics.failures_as_one(fixtures.judgments(spark, sf)))


@query("SELECT 'derived' AS judge, round(avg((verdict = 'CORRECT')::INT) FILTER (judge_error = '' AND verdict <> '' AND arm = 'bm25'), 9) AS bm25, round(avg((verdict = 'CORRECT')::INT) FILTER (judge_error = '' AND verdict <> '' AND arm = 'bm25_flat'), 9) AS bm25_flat, CAST(NULL AS DOUBLE) AS neural FROM ju")
def combined_summary(spark: SparkSession, sf: str) -> DataFrame:
    long = _summary(fixtures.judgments(spark, sf)).withColumn("judge", F.lit("derived"))
    return metrics.combined(long, ["bm25", "bm25_flat", "neural"], "accuracy", "judge")


_P = "CASE WHEN {w} + {l} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({w}, {l}) + 1), lambda i: exp(lgamma({w} + {l} + 1) - lgamma(i + 1) - lgamma({w} + {l} - i + 1) - ({w} + {l}) * ln(2))))) END"


@query(f"SELECT n, \"both\", a_only, b_only, neither, round({_P.format(w='a_only', l='b_only')}, 9) AS p_value FROM (SELECT count(*) AS n, count(*) FILTER (a AND b) AS \"both\", count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (NOT a AND b) AS b_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM pairs)")
def paired_contingency(spark: SparkSession, sf: str) -> DataFrame:
    return paired.contingency(paired.paired(fixtures.flags(spark, sf), "bm25", "bm25_flat", "exact_1")).withColumn("p_value", F.round("p_value", 9))


_DELTA = ", ".join(f"count(*) FILTER (a - b = {k}) AS delta_{'m' if k < 0 else 'p'}{abs(k)}" for k in range(-4, 5))


@query(f"SELECT *, round({_P.format(w='wins', l='losses')}, 9) AS p_value FROM (SELECT count(a - b) AS n, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, count(*) FILTER (a = b) AS ties, round(avg(a - b), 9) AS mean_delta, {_DELTA} FROM pscore)")
def paired_delta_hist(spark: SparkSession, sf: str) -> DataFrame:
    out = paired.deltas(paired.paired(fixtures.judgments(spark, sf), "bm25", "bm25_flat", "score"))
    return out.withColumns({"p_value": F.round("p_value", 9), "mean_delta": F.round("mean_delta", 9)})


@query("SELECT " + ", ".join(f"count(*) FILTER (a = {i} AND b = {j}) AS from_{i}_to_{j}" for i in range(1, 6) for j in range(1, 6)) + " FROM pscore")
def paired_transition(spark: SparkSession, sf: str) -> DataFrame:
    return paired.transitions(paired.paired(fixtures.judgments(spark, sf), "bm25", "bm25_flat", "score"))


@query(f"SELECT o_custkey, round(ln({_P.format(w='w', l='l')}), 6) + 0.0 AS ln_p_value FROM (SELECT o_custkey, count(*) FILTER (o_totalprice > 150000) AS w, count(*) FILTER (o_totalprice < 150000) AS l FROM orders GROUP BY o_custkey)")
def sign_test_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(metrics.count_if(F.col("o_totalprice") > 150000).alias("w"), metrics.count_if(F.col("o_totalprice") < 150000).alias("l"))
    return o.select("o_custkey", (F.round(F.log(sign_test(F.col("w"), F.col("l"))), 6) + 0.0).alias("ln_p_value"))


# assembly --------------------------------------------------------------------------------------------


@query("SELECT q.query_id, " + ", ".join(f"max(verdict) FILTER (arm = '{a}') AS {a}__verdict, max(score) FILTER (arm = '{a}') AS {a}__score" for a in ("bm25", "bm25_flat")) + " FROM q LEFT JOIN ju USING (query_id) GROUP BY q.query_id")
def wide_results(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.widened(fixtures.questions(spark, sf).select("query_id"), fixtures.judgments(spark, sf), "arm", ["bm25", "bm25_flat"], ["verdict", "score"])


@query("SELECT query_id, arm AS cell, verdict, score FROM ju")
def unpivot_arms(spark: SparkSession, sf: str) -> DataFrame:
    cells = {a: {f: f"{a}__{f}" for f in ("verdict", "score")} for a in ("bm25", "bm25_flat")}
    return assemble.lengthened(wide_results(spark, sf), cells, ["query_id"])


@query("SELECT conv_id, turn, text AS question, CAST(NULL AS VARCHAR) AS reply FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, NULL, text FROM conversations WHERE role = 'assistant'")
def union_missing_cols(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return assemble.stacked(asked, c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reply")))


@query("SELECT query_id, source_row, CASE WHEN source_row % 5 < 3 AND source_row % 7 = 0 THEN 'new' ELSE 'old' END AS state FROM q WHERE source_row % 5 < 3 UNION ALL SELECT query_id, source_row, 'new' FROM q WHERE source_row % 5 >= 3")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    q = fixtures.passages(spark, sf).select("query_id", "source_row")
    old = q.where("source_row % 5 < 3").withColumn("state", F.lit("old"))
    new = q.where("source_row % 5 >= 3 OR source_row % 7 = 0").withColumn("state", F.lit("new"))
    return assemble.upserted(old, new, keys=["query_id"])


@query("SELECT query_id, source_row FROM q WHERE source_row % 5 >= 3 OR source_row % 7 = 0")
def pending_anti(spark: SparkSession, sf: str) -> DataFrame:
    q = fixtures.passages(spark, sf).select("query_id", "source_row")
    prior = q.where("source_row % 5 < 3").withColumn("error", F.when(F.col("source_row") % 7 == 0, "boom").otherwise(""))
    return assemble.pending(q, prior, ["query_id"], "error")


@query("SELECT query_id FROM q WHERE EXISTS (SELECT 1 FROM q p WHERE p.source_row % 3 = 0 AND p.question = q.question AND p.golden_answer = q.golden_answer)")
def cohort_semi(spark: SparkSession, sf: str) -> DataFrame:
    q = fixtures.passages(spark, sf)
    return assemble.cohort(q, q.where("source_row % 3 = 0")).select("query_id")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY f) AS roles FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.ordered_list(table(spark, sf, "conversations"), "conv_id", "turn", "role", "roles").select("conv_id", F.array_join("roles", ",").alias("roles"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS source_row, printf('%s-%06d', role, turn) AS row_id FROM conversations")
def running_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    c = assemble.ordinals(table(spark, sf, "conversations"), "conv_id", "turn")
    return c.select("conv_id", "turn", "source_row", T.padded_id(F.col("role"), F.col("turn")).alias("row_id"))


@query("SELECT o_orderkey, o_custkey, r[3] AS last_flag FROM (SELECT o_orderkey, o_custkey, max(row(l_linenumber, l_extendedprice, l_returnflag)) AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)")
def lookup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag").withColumnRenamed("l_orderkey", "o_orderkey")
    return assemble.lookup(table(spark, sf, "orders", "o_orderkey", "o_custkey"), lines, "o_orderkey", "l_returnflag", F.struct("l_linenumber", "l_extendedprice", "l_returnflag"), "last_flag")


# checks -----------------------------------------------------------------------------------------------


_PLANTED = """(WITH c AS (SELECT q.query_id, source_row, count(unit_id) AS n FROM q LEFT JOIN ba_top USING (query_id) GROUP BY ALL), p AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE source_row % 13 = 0)
 SELECT *, n * (CASE WHEN source_row % 10 = 0 THEN 2 ELSE 1 END) AS n_items, n + (source_row % 5 = 0)::INT AS told FROM p)"""
_FAULTS = {"row_count": "CASE WHEN count(*) = (SELECT count(*) FROM benchmark) THEN 0 ELSE 1 END", "unique_query_id": "count(*) - count(DISTINCT query_id)", "null_key": "count(*) FILTER (query_id IS NULL)", "blank_question": "count(*) FILTER (source_row % 7 = 0)", "null_answer": "count(*) FILTER (source_row % 9 = 0)",
           "too_many_items": "count(*) FILTER (n_items > 4)", "count_differs": "count(*) FILTER (n_items <> told)", "error": "count(*) FILTER (source_row % 11 = 0)"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS \"check\", (SELECT {sql} FROM {_PLANTED}) AS n_violations" for name, sql in _FAULTS.items()))
def dq_result_violations(spark: SparkSession, sf: str) -> DataFrame:
    r, row = fixtures.results(spark, sf, "bm25"), F.col("source_row")
    r = r.withColumns({"question": F.when(row % 7 == 0, " \t").otherwise(F.col("question")), "golden_answer": F.when(row % 9 != 0, F.col("golden_answer")), "retrieved_items": F.when(row % 10 == 0, F.concat("retrieved_items", "retrieved_items")).otherwise(F.col("retrieved_items")),
                       "retrieved_count": F.col("retrieved_count") + (row % 5 == 0).cast("int"), "retrieval_error": F.when(row % 11 == 0, "boom").otherwise("")})
    return checks.results(r.union(r.where(row % 13 == 0)), table(spark, sf, "benchmark", "item_id"))


@query("SELECT 'unique_doc_id_source' AS \"check\", (SELECT count(*) FROM (SELECT doc_id, source FROM documents GROUP BY ALL HAVING count(*) > 1)) AS n_violations UNION ALL SELECT 'unique_source', (SELECT count(*) FROM (SELECT source FROM documents GROUP BY ALL HAVING count(*) > 1))")
def dq_unique(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents", "doc_id", "source")
    return checks.together(checks.unique(d, ["doc_id", "source"]), checks.unique(d, ["source"]))


def _tampered(results: DataFrame) -> DataFrame:
    """The best unit of every sixth question and the document of the second of every eighth are unknown."""
    item = lambda x: x.withField("unit_id", F.when((x["rank"] == 1) & (F.col("source_row") % 6 == 0), "nowhere").otherwise(x["unit_id"])).withField("doc_id", F.when((x["rank"] == 2) & (F.col("source_row") % 8 == 0), "nowhere").otherwise(x["doc_id"]))
    return results.withColumn("retrieved_items", F.transform("retrieved_items", item))


@query("SELECT 'known_unit' AS \"check\", (SELECT count(*) FROM ranked2 JOIN q USING (query_id) WHERE rank = 1 AND source_row % 6 = 0) AS n_violations UNION ALL SELECT 'allowed_document', (SELECT count(*) FROM ranked2 JOIN q USING (query_id) WHERE rank = 2 AND source_row % 8 = 0)")
def dq_doc_filter(spark: SparkSession, sf: str) -> DataFrame:
    return checks.doc_filter(_tampered(fixtures.results(spark, sf)), fixtures.questions(spark, sf), fixtures.words_document(spark, sf))


@query(" UNION ALL ".join(f"SELECT 'monotone_{k}_{k + 1}' AS \"check\", count(*) FILTER (exact_{k} AND NOT exact_{k + 1}) AS n_violations FROM fl" for k in range(1, 4)))
def dq_monotone(spark: SparkSession, sf: str) -> DataFrame:
    return checks.monotone(fixtures.flags(spark, sf))


@query("SELECT 'missing_key' AS \"check\", (SELECT count(*) FROM q WHERE source_row % 11 = 0) AS n_violations UNION ALL SELECT 'unknown_key', 0")
def dq_key_coverage(spark: SparkSession, sf: str) -> DataFrame:
    r = fixtures.flags(spark, sf).where("NOT (arm = 'bm25_flat' AND source_row % 11 = 0)")
    return checks.coverage(r, fixtures.questions(spark, sf), ["bm25", "bm25_flat"])


@query("SELECT 'verdict' AS \"check\", 0 AS n_violations UNION ALL SELECT 'score', 0 UNION ALL SELECT 'score_missing', (SELECT count(*) FROM ju WHERE score IS NULL AND judge_fallback = '') UNION ALL SELECT 'error', (SELECT count(*) FROM ju WHERE judge_error <> '')")
def dq_judgments(spark: SparkSession, sf: str) -> DataFrame:
    return checks.judgments(fixtures.judgments(spark, sf))


# samples and hashes --------------------------------------------------------------------------------------


@query("SELECT query_id, selection_key, row_number() OVER (ORDER BY selection_key, source_row, query_id) AS selection_rank FROM (SELECT *, sha256('pilot' || chr(10) || query_id) AS selection_key FROM q WHERE split = 'dev') QUALIFY selection_rank <= 100")
def stable_sample_100(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stable_sample(fixtures.passages(spark, sf), 100, "pilot").select("query_id", "selection_key", F.col("selection_rank").cast("long").alias("selection_rank"))


@query("SELECT sha256(string_agg(query_id || chr(9) || sha256(question), chr(10) ORDER BY source_row)) AS sha256, count(*) AS n_rows FROM q")
def ordered_context_hash(spark: SparkSession, sf: str) -> DataFrame:
    q = fixtures.passages(spark, sf).withColumn("h", T.sha256(F.col("question")))
    return sampling.ordered_hash(q, "source_row", "query_id", "h")


@query("SELECT sha256(string_agg(DISTINCT source, chr(10) ORDER BY source)) AS sha256 FROM documents")
def set_hash(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.set_hash(table(spark, sf, "documents", "source"), "source")


@query("SELECT prompt_name, mean_accuracy, n_cells FROM (SELECT lang AS prompt_name, round(avg(quality), 9) AS mean_accuracy, count(*) AS n_cells FROM documents JOIN labels USING (doc_id) GROUP BY lang) ORDER BY mean_accuracy DESC, strlen(prompt_name), prompt_name LIMIT 1")
def prompt_winner(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "documents", "doc_id", "lang").join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id").select(F.col("lang").alias("prompt_name"), F.col("lang").alias("prompt"), F.col("quality").alias("accuracy"))
    return sampling.prompt_winner(cells).select("prompt_name", F.round("mean_accuracy", 9).alias("mean_accuracy"), "n_cells")


# generation and judging with the offline stubs --------------------------------------------------------------


def _work(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.results(spark, sf, "bm25").select("query_id", "arm", "question", "golden_answer", ranking.context().alias("context"))


_GAP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_words = lambda x: f"list_filter(string_split_regex({x}, '{_GAP}'), lambda w: w <> '')"
_CONTEXT = f"""c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) FILTER (len({_words('text')}) > 0) AS context FROM ba_top JOIN d USING (unit_id) GROUP BY query_id),
 w AS (SELECT query_id, question, golden_answer, coalesce(context, '') AS context FROM q LEFT JOIN c USING (query_id)),
 p AS (SELECT *, 'Answer from the context alone.' || repeat(chr(10), 2) || 'Context:' || chr(10) || context || repeat(chr(10), 2) || 'Question: ' || question AS prompt, {_words('context')}[1:12] AS first FROM w),
 a AS (SELECT *, CASE WHEN len(first) = 0 THEN '{answers.REFUSAL}' ELSE array_to_string(first, ' ') END AS answer, CASE WHEN len(first) = 0 THEN 0 ELSE len({_words('prompt')}) END AS n_in FROM p)"""
_GENERATED = """SELECT query_id, 'bm25' AS arm, 'stub' AS model, 'v1' AS prompt_version, sha256(question || chr(10) || context) AS content_sha256, answer AS generated_answer, '' AS generation_error, n_in AS input_tokens, len(first) AS output_tokens,
 sha256(answer || chr(10)) AS generation_sha256, '' AS response_id, n_in + len(first) AS total_tokens, '' AS response_model, '' AS response_provider, sha256(context) AS retrieval_context_sha256 FROM a"""


def _after(ctes: str, statement: str) -> str:
    return f"SELECT * FROM (WITH {ctes} {statement})"


@query(_after(_CONTEXT, _GENERATED))
def stub_generate(spark: SparkSession, sf: str) -> DataFrame:
    return answers.generated(_work(spark, sf), answers.stub_writer, "stub", "v1")


_JUDGED = """, j AS (SELECT query_id, sha256(answer || chr(10)) AS generation_sha256, 'Compare the answer with the reference. Reply with a JSON object of score and reason.' || repeat(chr(10), 2) || 'Question: ' || question || chr(10) || 'Reference: ' || golden_answer || chr(10) || 'Answer: ' || answer AS ask FROM a)"""


@query(_after(_CONTEXT + _JUDGED, f"SELECT query_id, 'bm25' AS arm, 'stub' AS judge_model, 'scale-1-5' AS judge_mode, generation_sha256, '' AS verdict, CAST(CAST('0x' || substr(sha256(ask), 1, 8) AS BIGINT) % 5 + 1 AS INT) AS score, 'stub' AS reason, '' AS judge_error, '' AS judge_fallback, len({_words('ask')}) + 8 AS judge_total_tokens, '' AS judge_response_id, len({_words('ask')}) AS judge_input_tokens, 8 AS judge_output_tokens, '' AS judge_response_model, '' AS judge_response_provider FROM j"))
def stub_judge(spark: SparkSession, sf: str) -> DataFrame:
    made = stub_generate(spark, sf).select("query_id", "arm", "generated_answer", "generation_error", "generation_sha256")
    return answers.judged(_work(spark, sf).join(made, ["query_id", "arm"]), answers.stub_judge, "stub", "scale-1-5")


@query(_after(_CONTEXT, _GENERATED))
def resumed_generate(spark: SparkSession, sf: str) -> DataFrame:
    """From a checkpoint that hangs on the folder alone, so that a later run goes on where one stopped."""
    path = f"{scratch.root(spark)}/quillon-resumed-{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    step = lambda df: answers.generated(df, answers.stub_writer, "stub", "v1")
    keys = ["query_id", "arm", "content_sha256"]
    work = _work(spark, sf).withColumn("content_sha256", T.sha256(F.concat_ws("\n", "question", "context")))
    return answers.resumed(spark, work, step, path, answers.GENERATION, keys, "generation_error", batches=2)


@query(r"""SELECT page_id, ordinal, CASE WHEN ordinal IS NULL THEN 'no ordinal' ELSE '' END AS error, CASE WHEN ordinal IS NULL THEN 2 ELSE 1 END AS attempts
 FROM (SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '(\d+)$', 1), '') AS BIGINT) AS ordinal FROM pages)""")
def timed_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as a stream; those whose url ends in no number come a second time, when their timer is up."""
    pages = table(spark, sf, "pages", "page_id", "url")
    stream = spark.readStream.schema(pages.schema).parquet(f"{sf}/pages.parque[t]")  # a pattern, since a stream's path that is one file must not be its base
    ordinal = T.trailing_ordinal(F.col("url"))
    step = lambda df: df.select("page_id", ordinal.alias("ordinal"), F.when(ordinal.isNull(), "no ordinal").otherwise("").alias("error"))
    path = f"{scratch.root(spark)}/quillon-{uuid.uuid4().hex}"
    running = attempts.retried(stream, step, path, ["page_id"], "error", most=2, wait_ms=200, every="200 milliseconds", partitions=8)
    return attempts.settled(running, spark, path, f"{pages.select('page_id').schema.toDDL()}, ordinal long, error string", pages.select("page_id").distinct().count(), 900)


# columns, ids and alignment ---------------------------------------------------------------------------------


@query("SELECT conv_id, turn, concat_ws('|', conv_id, CASE WHEN role <> 'user' THEN role END, turn) AS short_id, concat_ws('|', conv_id, CASE WHEN role <> 'user' THEN role ELSE '' END, turn) AS full_id, CASE WHEN turn % 2 = 0 THEN 'own-' || conv_id ELSE concat_ws('|', conv_id, turn) END AS unit_id FROM conversations")
def compound_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations", "conv_id", "turn", "role").withColumn("part", F.when(F.col("role") != "user", F.col("role")))
    given = c.withColumn("unit_id", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("own-"), "conv_id")).otherwise(""))
    parts = [F.col("conv_id"), F.col("part"), F.col("turn")]
    return given.select("conv_id", "turn", T.compound_id(*parts).alias("short_id"), T.compound_id(*parts, keep_missing=True).alias("full_id"), columns.excerpt_unit_id(given, ("conv_id", "turn")).alias("unit_id"))


@query("SELECT query_id, split AS golden_answer, golden_answer AS reference_evidence, source_row FROM q WHERE source_row % 4 < 3")
def role_swap(spark: SparkSession, sf: str) -> DataFrame:
    q = fixtures.passages(spark, sf).withColumn("retrieval_method", F.when(F.col("source_row") % 4 == 0, "bm25").when(F.col("source_row") % 4 == 3, "other").otherwise("okapi"))
    q = columns.of_dataset(columns.method_rows(q, "bm25", {"bm25": ("okapi",)}), "BENCH")
    return columns.role_swapped(q, "split").select("query_id", "golden_answer", "reference_evidence", "source_row")


@query("SELECT q.query_id, q.source_row, coalesce((SELECT max(s.r) FROM (SELECT CASE WHEN source_row % 4 = 0 THEN source_row + 1000 ELSE source_row END AS r, g FROM q) s WHERE s.r = q.source_row AND s.g = q.g), (SELECT CASE WHEN count(*) = 1 THEN min(s.r) END FROM (SELECT CASE WHEN source_row % 4 = 0 THEN source_row + 1000 ELSE source_row END AS r, g FROM q) s WHERE s.g = q.g)) AS matched_row FROM q")
def aligned_rows(spark: SparkSession, sf: str) -> DataFrame:
    q = fixtures.passages(spark, sf)
    moved = q.withColumn("source_row", F.when(F.col("source_row") % 4 == 0, F.col("source_row") + 1000).otherwise(F.col("source_row")))
    return assemble.aligned(q, moved, "source_row", T.normalized(F.col("question")), T.normalized(F.col("question"))).select("query_id", "source_row", "matched_row")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'not_requested' ELSE 'high' END AS run__effort, CASE WHEN turn % 2 = 0 THEN turn ELSE strlen(role) END AS run__total_tokens FROM conversations")
def usage_fields(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations", "conv_id", "turn", "role")
    c = c.withColumns({"effort": T.effort(F.when(F.col("turn") % 3 == 0, "none").otherwise("high")), "total_tokens": T.total_tokens(F.when(F.col("turn") % 2 == 0, F.col("turn")), F.octet_length("role"))})
    return assemble.namespaced(c, "run", ["effort", "total_tokens", "absent"], ["conv_id", "turn"])


@query("SELECT item_id, CASE WHEN item_id % 6 BETWEEN 1 AND 4 THEN '' ELSE 'excerpt count' END AS retrieval_error, item_id % 6 AS retrieved_count, CASE WHEN item_id % 6 = 0 THEN '' ELSE sha256('part ' || (item_id % 6)) END AS last_sha256 FROM benchmark")
def imported_rankings(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("item_id") % 6
    parts = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit(" part "), i.cast("string"))), "\n ... \n")).otherwise(" ")
    df = ranking.import_ranked(table(spark, sf, "benchmark", "item_id").withColumn("neural", parts), "neural", "neural")
    last = F.try_element_at("retrieved_items", F.lit(-1))["text"]
    return df.select("item_id", "retrieval_error", "retrieved_count", F.when(n > 0, T.sha256(last)).otherwise("").alias("last_sha256"))


# means, rates and reports --------------------------------------------------------------------------------------


@query(f"SELECT arm, count(DISTINCT query_id) AS n_questions, {', '.join(f'round(avg({kind}_{k}::INT), 9) AS mean_{kind}_{k}' for kind in ('exact', 'relaxed') for k in range(1, 5))} FROM fl JOIN (SELECT query_id, arm, {_RELAXED} FROM (SELECT *, {_GRAMS.format('qt')} AS gg, {', '.join(f'{_GRAMS.format(f"s{k}")} AS e{k}' for k in range(1, 5))} FROM (SELECT *, {', '.join(f"string_split(coalesce(c{k}, ''), ' ') AS s{k}" for k in range(1, 5))} FROM fl))) r USING (query_id, arm) GROUP BY arm")
def presence_means(spark: SparkSession, sf: str) -> DataFrame:
    both = fixtures.flags(spark, sf).join(metrics.relaxed(fixtures.results(spark, sf)), ["query_id", "arm"])
    out = metrics.presence_means(both, "arm")
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.startswith("mean_")})


_GIVEN = "SELECT * REPLACE (CASE WHEN arm = 'bm25_flat' AND source_row % 7 = 0 THEN 'before ' || g || ' after' ELSE c1 END AS c1, CASE WHEN arm = 'bm25_flat' AND source_row % 5 = 0 THEN '' ELSE c2 END AS c2) FROM fl"
_RATES = f"""SELECT arm, {', '.join(f"round(sum(coalesce(f, 0) / n_gold) FILTER (k = {k}) / count(*) FILTER (k = {k}), 9) AS recall_{k}, round(count(f) FILTER (k = {k}) / count(*) FILTER (k = {k}), 9) AS hit_{k}" for k in range(1, 5))}
 FROM (SELECT query_id, count(*) AS n_gold FROM ({_QRELS}) GROUP BY query_id) g CROSS JOIN (VALUES ('bm25'), ('bm25_flat')) a(arm) CROSS JOIN (VALUES (1), (2), (3), (4)) k(k)
 LEFT JOIN (SELECT r.arm, r.query_id, kk.k, count(*) AS f FROM ranked2 r JOIN ({_QRELS}) x ON x.query_id = r.query_id AND x.unit_id = r.unit_id JOIN (VALUES (1), (2), (3), (4)) kk(k) ON r.rank <= kk.k GROUP BY ALL) h USING (arm, k, query_id) GROUP BY arm"""


@query(f"""SELECT * FROM (SELECT arm, count(DISTINCT query_id) AS n_questions, count(*) FILTER (arm = 'bm25' AND source_row % 13 = 0) AS retrieval_errors,
 {', '.join(f"round(avg((g <> '' AND contains(coalesce(c{k}, ''), g))::INT), 9) AS mean_exact_{k}, round(avg(relaxed_{k}::INT), 9) AS mean_relaxed_{k}" for k in range(1, 5))}, round(avg(exact_full::INT), 9) AS mean_exact_full
 FROM ({_GIVEN}) JOIN (SELECT query_id, arm, {_RELAXED} FROM (SELECT *, {_GRAMS.format('qt')} AS gg, {', '.join(f'{_GRAMS.format(f"s{k}")} AS e{k}' for k in range(1, 5))} FROM (SELECT *, {', '.join(f"string_split(coalesce(c{k}, ''), ' ') AS s{k}" for k in range(1, 5))} FROM ({_GIVEN})))) r USING (query_id, arm)
 JOIN fulld USING (query_id) GROUP BY arm) JOIN ({_RATES}) USING (arm)""")
def handoff_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Two arms, of which one has errors and the other contexts of its own for some questions, one of them empty."""
    q, docs = fixtures.questions(spark, sf), fixtures.words_document(spark, sf)
    arm, row = fixtures.results(spark, sf), F.col("source_row")
    failing = arm.where("arm = 'bm25'").withColumn("retrieval_error", F.when(row % 13 == 0, "timeout").otherwise(""))
    own = arm.where("arm = 'bm25_flat'").withColumns({"containment_context_1": F.when(row % 7 == 0, F.concat(F.lit("Before: "), "golden_answer", F.lit(" ... after"))), "containment_context_2": F.when(row % 5 == 0, "")})
    flags, _, rates = pipelines.handoff(q, docs, [failing, own], metrics.substring_qrels(q, docs, keep=scratch.kept))
    out = pipelines.handoff_summary(flags, rates)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.startswith(("mean_", "recall_", "hit_"))})


@query("""SELECT 'generation_missing' AS "check", (SELECT count(*) FROM armq WHERE source_row % 23 = 0 AND arm = 'bm25') AS n_violations UNION ALL SELECT 'generation_unknown', 0 UNION ALL SELECT 'generation_unique_query_id_arm', 0
 UNION ALL SELECT 'generation_other_model', (SELECT count(*) FROM armq WHERE source_row % 11 = 0 AND NOT (source_row % 23 = 0 AND arm = 'bm25')) UNION ALL SELECT 'generation_other_effort', (SELECT count(*) FROM armq WHERE source_row % 9 = 0 AND NOT (source_row % 23 = 0 AND arm = 'bm25'))
 UNION ALL SELECT 'generation_generation_error', 0 UNION ALL SELECT 'generation_blank_answer', (SELECT count(*) FROM armq WHERE source_row % 8 = 0 AND NOT (source_row % 23 = 0 AND arm = 'bm25'))
 UNION ALL SELECT 'judgment_missing', 0 UNION ALL SELECT 'judgment_unknown', 0 UNION ALL SELECT 'judgment_unique_query_id_arm', 0 UNION ALL SELECT 'judgment_other_judge_model', 0
 UNION ALL SELECT 'judgment_judge_error', (SELECT count(*) FROM ju WHERE judge_error <> '') UNION ALL SELECT 'judgment_verdict', (SELECT count(*) FROM ju WHERE verdict = '') UNION ALL SELECT 'judgment_blank_reason', (SELECT count(*) FROM armq WHERE source_row % 6 = 0)""")
def dq_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of one model with planted faults: rows of another model or effort, lacking rows, blank answers and reasons, failed judgments."""
    work, row = fixtures.results(spark, sf).select("query_id", "arm", "source_row", "golden_answer"), F.col("source_row")
    made = work.where(~((row % 23 == 0) & (F.col("arm") == "bm25"))).select("query_id", "arm", F.when(row % 11 == 0, "other").otherwise("m").alias("model"), F.when(row % 9 != 0, "low").alias("effort"), F.when(row % 8 == 0, " \t").otherwise("said").alias("generated_answer"), F.lit("").alias("generation_error"))
    judged = fixtures.judgments(spark, sf).withColumns({"judge_model": F.lit("j"), "reason": F.when(row % 6 != 0, "because")})
    return checks.outputs(work, made, judged, {"model": "m", "effort": "low"}, {"judge_model": "j"})


@query("SELECT 'exact' AS value, round(avg(a::INT), 9) AS a_mean, round(avg(b::INT), 9) AS b_mean, round(avg(a::INT - b::INT), 9) AS difference FROM pairs UNION ALL SELECT 'score', round(avg(a), 9), round(avg(b), 9), round(avg(a - b), 9) FROM pscore")
def paired_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = {"exact": (fixtures.flags(spark, sf), "exact_1"), "score": (fixtures.judgments(spark, sf), "score")}
    parts = [paired.means(paired.paired(df, "bm25", "bm25_flat", value)).withColumn("value", F.lit(name)) for name, (df, value) in rows.items()]
    return parts[0].unionByName(parts[1]).select("value", *[F.round(c, 9).alias(c) for c in ("a_mean", "b_mean", "difference")])


@query("SELECT " + ", ".join(f"count(*) FILTER ({x} = {k}) AS {x}_score_{k}" for x in "ab" for k in range(1, 6)) + " FROM pscore")
def paired_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return paired.histograms(paired.paired(fixtures.judgments(spark, sf), "bm25", "bm25_flat", "score"))


@query(f"""WITH c AS (SELECT role, turn, {_REPLIES}, CASE WHEN turn % 3 = 0 THEN 'Entailment' ELSE 'Contradiction' END AS gold FROM conversations), l AS (SELECT *, {_LABEL} AS label FROM c)
 SELECT role, count(*) AS n_rows, count(*) FILTER (turn % 5 = 0) AS n_errors, round(avg((label IS NOT NULL)::INT), 9) AS parse_rate, round(avg(coalesce(label = lower(gold), false)::INT), 9) AS label_accuracy FROM l GROUP BY role""")
def label_rates(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations", "conv_id", "role", "turn", "text")
    made = c.select("role", _replies().alias("generated_answer"), F.when(F.col("turn") % 3 == 0, "Entailment").otherwise("Contradiction").alias("golden_answer"), F.when(F.col("turn") % 5 == 0, "boom").otherwise("").alias("generation_error"))
    out = metrics.label_summary(answers.labelled(made), "role")
    return out.withColumns({x: F.round(x, 9) for x in ("parse_rate", "label_accuracy")})


@query("SELECT 'derived' AS judge, metric, round(max(v) FILTER (arm = 'bm25'), 9) AS bm25, round(max(v) FILTER (arm = 'bm25_flat'), 9) AS bm25_flat FROM (SELECT arm, 'accuracy' AS metric, avg((verdict = 'CORRECT')::INT) FILTER (judge_error = '' AND verdict <> '') AS v FROM ju GROUP BY arm UNION ALL SELECT arm, 'mean_score', avg(score) FILTER (judge_error = '') FROM ju GROUP BY arm) GROUP BY metric")
def published_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.published_metrics(_summary(fixtures.judgments(spark, sf)).withColumn("judge", F.lit("derived")), ["bm25", "bm25_flat"])


@query("SELECT round(avg(n), 9) AS mean_sentences, round(avg(dropped), 9) AS mean_dropped FROM (SELECT query_id, count(*) FILTER (is_first) AS n, count(*) FILTER (NOT is_first) AS dropped FROM win WHERE query_id IN (SELECT query_id FROM anc GROUP BY query_id HAVING count(*) = 4) GROUP BY query_id)")
def window_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Of the questions whose anchors pass the checks: four ranks in one document."""
    anchors, sentences = fixtures.anchors(spark, sf), fixtures.sentences(spark, sf)
    sound = anchors.join(windows.anchor_faults(anchors, sentences), "query_id", "left_anti")
    audit = pipelines.window_inputs(fixtures.passages(spark, sf), sound, sentences)[2]
    return audit.select(F.round("mean_sentences", 9).alias("mean_sentences"), F.round("mean_dropped", 9).alias("mean_dropped"))


@query("SELECT 'outside' AS problem, (SELECT count(*) + count(*) FILTER (source_row % 7 = 0) FROM q WHERE source_row % 5 = 0) AS n UNION ALL SELECT 'repeated', (SELECT count(*) FROM q WHERE source_row % 7 = 0) UNION ALL SELECT 'changed', (SELECT count(*) + count(*) FILTER (source_row % 7 = 0) FROM q WHERE source_row % 3 = 0 AND source_row % 5 <> 0)")
def cohort_faults(spark: SparkSession, sf: str) -> DataFrame:
    q = fixtures.passages(spark, sf).select("query_id", "source_row", T.sha256(F.col("question")).alias("h"))
    prior = q.withColumn("h", F.when(F.col("source_row") % 3 == 0, "other").otherwise(F.col("h")))
    return sampling.cohort_faults(prior.union(prior.where("source_row % 7 = 0")), q.where("source_row % 5 <> 0"), "query_id", ["h"])


@query("SELECT 'summary_score' AS \"check\", (SELECT count(*) FROM ju WHERE score IS NULL OR source_row % 4 = 0) AS n_violations UNION ALL SELECT 'golden_counts', (SELECT count(*) FROM (SELECT source FROM documents GROUP BY source) WHERE source <> 'src1') UNION ALL SELECT 'variants_agree', (SELECT 2 * count(*) FROM q WHERE source_row % 9 = 0) UNION ALL SELECT 'size_limit', (SELECT count(*) FROM documents WHERE strlen(text) > 4096)")
def dq_agreements(spark: SparkSession, sf: str) -> DataFrame:
    j, q = fixtures.judgments(spark, sf), fixtures.passages(spark, sf)
    told = j.withColumn("score", F.when(F.col("source_row") % 4 == 0, F.col("score") + 0.5).otherwise(F.col("score")))
    n = table(spark, sf, "documents", "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    wanted = n.withColumn("n", F.when(F.col("source") == "src1", F.col("n")).otherwise(F.col("n") + 1))
    other = q.withColumn("question", F.when(F.col("source_row") % 9 == 0, "other").otherwise(F.col("question")))
    sizes = table(spark, sf, "documents", "text").select(F.octet_length("text").alias("bytes"))
    return checks.together(checks.summary_matches(j, told, ["query_id", "arm"], "score"), checks.golden(n, wanted, "source"), checks.same_except(q, other, "query_id", ["question", "golden_answer"]), checks.size_limit(sizes, 4096))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_and_json_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Half of a table through CSV and half through JSON lines."""
    n, path = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey"), f"{scratch.root(spark)}/quillon-{uuid.uuid4().hex}"
    n.where("n_nationkey % 2 = 0").write.option("header", True).csv(f"{path}/csv")
    n.where("n_nationkey % 2 = 1").write.json(f"{path}/json")
    read = tables.csv(spark, f"{path}/csv").unionByName(tables.json_lines(spark, f"{path}/json", "n_nationkey string, n_name string, n_regionkey string"))
    return read.select(*[F.col(f.name).cast(f.dataType) for f in n.schema])


@query("SELECT row_number() OVER (ORDER BY n_nationkey % 3, n_nationkey) - 1 AS place, n_nationkey FROM nation")
def parts_in_path_order(spark: SparkSession, sf: str) -> DataFrame:
    n, path = table(spark, sf, "nation", "n_nationkey"), f"{scratch.root(spark)}/quillon-{uuid.uuid4().hex}"
    for k in range(3):
        n.where(F.col("n_nationkey") % 3 == k).coalesce(1).sortWithinPartitions("n_nationkey").write.parquet(f"{path}/part-{k}")
    df = tables.parts(spark, f"{path}/part-*").withColumn("all", F.lit(""))
    return assemble.ordinals(df, "all", F.struct("part", "part_row"), "place").select("place", "n_nationkey")


# joins by two keys and by place, windows of a search, texts sent ----------------------------------------------------


@query("SELECT query_id, source_row, golden_answer, 'other' AS golden_answer_other FROM q WHERE source_row % 6 = 0 AND source_row % 4 <> 0")
def matched_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Template rows beside the questions by two keys, and those whose answer isn't the question's."""
    q = fixtures.passages(spark, sf).select("query_id", "source_row", "question", "golden_answer")
    template = q.where("source_row % 4 <> 0").withColumn("golden_answer", F.when(F.col("source_row") % 6 == 0, "other").otherwise(F.col("golden_answer")))
    found = assemble.matched(q, template, ["query_id", "source_row"])
    return assemble.differing(found, ["question", "golden_answer"]).select("query_id", "source_row", "golden_answer", "golden_answer_other")


_PLACES = """(WITH a AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
 b AS (SELECT conv_id, CASE WHEN turn % 5 = 0 THEN 'x' ELSE role END AS role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE turn % 4 <> 3)
 SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, turn, coalesce(a.place, b.place) AS place, coalesce(a.role = b.role, false) AS same FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.place = b.place)"""


@query(f"SELECT conv_id, turn, CAST(NULL AS BIGINT) AS wrong_place FROM {_PLACES} WHERE same UNION ALL SELECT conv_id, NULL, place FROM {_PLACES} WHERE NOT same")
def joined_by_position(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations", "conv_id", "turn", "role")
    other = c.where("turn % 4 <> 3").select("conv_id", F.col("turn").alias("at"), F.when(F.col("turn") % 5 == 0, "x").otherwise(F.col("role")).alias("role"))
    rows, faults = assemble.by_position(c, other, "conv_id", "turn", "at", ["role"])
    return assemble.stacked(rows.select("conv_id", "turn"), faults.withColumnRenamed("position", "wrong_place"))


@query(f"""SELECT * FROM (WITH k AS (SELECT query_id, rank, string_agg(text, '' ORDER BY position) AS t, count(*) AS n FROM win WHERE is_first GROUP BY ALL)
 SELECT query_id, w.rank, sha256(coalesce(regexp_replace(t, '^{_GAP}|{_GAP}$', '', 'g'), '')) AS text_sha256, coalesce(n, 0) AS n_units FROM (SELECT DISTINCT query_id, rank FROM win) w LEFT JOIN k USING (query_id, rank))""")
def windows_of_hits(spark: SparkSession, sf: str) -> DataFrame:
    w = _windows(spark, sf).withColumn("u", F.struct("position", F.concat_ws("|", "doc_id", "position").alias("unit_id"), "text"))
    hits = w.groupBy("query_id", "rank").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("u")).alias("u"))
    context = F.transform("u", lambda x: F.struct(x["unit_id"].alias("unit_id"), x["text"].alias("text")))
    top = windows.of_hits(hits.select("query_id", "rank", "doc_id", F.lit("").alias("unit_id"), F.lit(0.0).alias("score"), F.lit("").alias("text"), context.alias("context")))
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), T.sha256(F.col("text")).alias("text_sha256"), F.col("n_units").cast("long").alias("n_units"))


@query("SELECT query_id, sha256('Read: ' || golden_answer || chr(10) || '{x} Asked: ' || question || '.') AS prompt_sha256 FROM q")
def prompt_texts(spark: SparkSession, sf: str) -> DataFrame:
    q = fixtures.passages(spark, sf)
    return q.select("query_id", T.sha256(answers.prompt(F.col("golden_answer"), F.col("question"), "Read: {context}\n{x} Asked: {question}.")).alias("prompt_sha256"))


@query("SELECT page_id, '[' || to_json(url) || ', ' || to_json('\"' || page_id || '\"') || ']' AS listed FROM pages")
def json_lists(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages", "page_id", "url")
    return p.select("page_id", T.json_list(F.array("url", F.concat(F.lit('"'), "page_id", F.lit('"')))).alias("listed"))


@query("SELECT role, count(*) AS questions, count(*) FILTER (turn % 5 = 0) AS generation_errors, count(*) FILTER (turn % 3 = 0) AS n_blank, count(*) FILTER (turn % 5 <> 0 AND turn % 4 = 0) AS n_unsent, CAST(sum(turn) AS BIGINT) AS total_tokens FROM conversations GROUP BY role")
def generation_summary(spark: SparkSession, sf: str) -> DataFrame:
    c, turn = table(spark, sf, "conversations", "role", "turn"), F.col("turn")
    made = c.select("role", F.when(turn % 3 == 0, " \t").otherwise("answer").alias("generated_answer"), F.when(turn % 5 == 0, "boom").otherwise("").alias("generation_error"), (turn % 4).alias("input_tokens"), turn.cast("long").alias("total_tokens"))
    return metrics.generation_summary(made, "role")


# whole reports, with planted faults ---------------------------------------------------------------------------------


def _report(faults: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS \"check\", ({sql}) AS n_violations" for name, sql in faults.items())


_ROWS = "(SELECT arm, query_id, source_row FROM armq WHERE NOT (arm = 'bm25_flat' AND source_row % 11 = 0) UNION ALL SELECT 'extra', query_id, source_row FROM q WHERE source_row % 13 = 0)"
_ITEMS = f"(SELECT rank, source_row FROM (SELECT arm, query_id, rank FROM ranked2 UNION ALL SELECT 'extra', query_id, rank FROM ba_top) i JOIN {_ROWS} r USING (arm, query_id))"
_QREL = "FROM ba_top JOIN q USING (query_id) WHERE"
_zeros = lambda *names: {n: "SELECT 0" for n in names}


@query(_report({
    "arms": f"SELECT count(DISTINCT arm) FROM {_ROWS} WHERE arm = 'extra'", "row_count": f"SELECT CASE WHEN (SELECT count(*) FROM {_ROWS}) = 2 * count(*) THEN 0 ELSE 1 END FROM q", "unique_query_id_arm": f"SELECT count(*) - count(DISTINCT (query_id, arm)) FROM {_ROWS}",
    "missing_key": "SELECT count(*) FROM q WHERE source_row % 11 = 0", "unknown_key": "SELECT count(*) FROM q WHERE source_row % 13 = 0", "null_question": f"SELECT count(*) FROM {_ROWS} WHERE source_row % 7 = 0", **_zeros("null_golden_answer", "null_retrieval_error", "null_retrieved_count", "null_retrieved_items"),
    "count_differs": f"SELECT count(*) FROM {_ROWS} WHERE source_row % 5 = 0", "known_unit": f"SELECT count(*) FROM {_ITEMS} WHERE rank = 1 AND source_row % 6 = 0", "allowed_document": f"SELECT count(*) FROM {_ITEMS} WHERE rank = 2 AND source_row % 8 = 0",
    "qrels_query": f"SELECT count(*) {_QREL} rank = 1 AND source_row % 9 = 0", "qrels_unit": f"SELECT count(*) {_QREL} rank = 2 AND source_row % 6 = 0", "qrels_document": f"SELECT count(*) {_QREL} rank = 1 AND source_row % 9 = 0",
}))
def dq_handoff(spark: SparkSession, sf: str) -> DataFrame:
    r, row = _tampered(fixtures.results(spark, sf)), F.col("source_row")
    r = r.withColumns({"question": F.when(row % 7 != 0, F.col("question")), "retrieved_count": F.col("retrieved_count") + (row % 5 == 0).cast("int")})
    extra = r.where("arm = 'bm25' AND source_row % 13 = 0").withColumn("arm", F.lit("extra"))
    q = fixtures.questions(spark, sf)
    relevant = fixtures.ranked(spark, sf).where("rank <= 2").join(q.select("query_id", "source_row"), "query_id")
    relevant = relevant.select(F.when((F.col("rank") == 1) & (row % 9 == 0), "nobody").otherwise(F.col("query_id")).alias("query_id"), F.when((F.col("rank") == 2) & (row % 6 == 0), "nowhere").otherwise(F.col("unit_id")).alias("unit_id"), "doc_id")
    return checks.handoff(r.where("NOT (arm = 'bm25_flat' AND source_row % 11 = 0)").unionByName(extra), q, fixtures.words_document(spark, sf), ["bm25", "bm25_flat"], relevant)


_MADE = "FROM armq WHERE NOT (arm = 'bm25' AND source_row % 11 = 0) AND"


@query(_report({
    "inputs_agree": "SELECT count(*) FROM q WHERE source_row % 14 = 0", **_zeros("unique_query_id_arm_model"), "missing_generation": "SELECT count(*) FROM q WHERE source_row % 11 = 0", **_zeros("unknown_generation"),
    "generation_error": f"SELECT count(*) {_MADE} source_row % 10 = 0", "blank_answer": f"SELECT count(*) {_MADE} source_row % 6 = 0", "prompt_version": f"SELECT count(*) {_MADE} source_row % 7 = 0", "context_hash": f"SELECT count(*) {_MADE} source_row % 9 = 0",
    **_zeros("unique_query_id_arm_model_judge_model"), "missing_judgment": f"SELECT count(*) {_MADE} source_row % 13 = 0", **_zeros("unknown_judgment"), "generation_hash": f"SELECT count(*) {_MADE} source_row % 13 <> 0 AND source_row % 5 = 0",
    **_zeros("judge_error", "verdict"), "score": f"SELECT count(*) {_MADE} source_row % 13 <> 0 AND source_row % 8 = 0", "blank_reason": f"SELECT count(*) {_MADE} source_row % 13 <> 0 AND source_row % 15 = 0",
}))
def dq_matrix(spark: SparkSession, sf: str) -> DataFrame:
    row, plant = F.col("source_row"), lambda n, bad, good: F.when(F.col("source_row") % n == 0, bad).otherwise(good)
    work = fixtures.results(spark, sf).select("query_id", "arm", "source_row", F.when((F.col("arm") == "bm25") & (row % 14 == 0), "other").otherwise(F.col("question")).alias("question"), "golden_answer", ranking.context().alias("context"))
    made = work.where("NOT (arm = 'bm25' AND source_row % 11 = 0)").select("query_id", "arm", "source_row", F.lit("m").alias("model"), plant(7, "old", "v").alias("prompt_version"), plant(6, " ", "a").alias("generated_answer"), plant(10, "boom", "").alias("generation_error"),
                                                                          plant(9, "", T.sha256(F.col("context"))).alias("retrieval_context_sha256"), T.sha256(F.col("query_id")).alias("generation_sha256"))
    judged = made.where("source_row % 13 <> 0").select("query_id", "arm", F.lit("m").alias("generator"), F.lit("j").alias("judge_model"), F.lit("scale-1-5").alias("judge_mode"), plant(5, "", F.col("generation_sha256")).alias("generation_sha256"), F.lit("").alias("verdict"),
                                                       plant(8, 7, 3).alias("score"), plant(15, " ", "why").alias("reason"), F.lit("").alias("judge_error"), F.lit("").alias("judge_fallback"))
    return checks.matrix(work, made, judged, ["m"], ["j"], "v")


def _packaged(arm: str) -> dict[str, str]:
    n = lambda k: f"SELECT count(*) FROM q WHERE source_row % {k} = 0"
    return {f"{arm}: rows": "SELECT CASE WHEN count(*) = 7 THEN 0 ELSE 1 END FROM q", f"{arm}: retrieval_errors": f"SELECT abs(({n(11)}) - 2)", f"{arm}: other_arm": n(10) if arm == "bm25" else "SELECT 0", f"{arm}: blank_question": n(7),
            f"{arm}: nan_text": f"SELECT count(DISTINCT query_id) FROM ranked2 JOIN q USING (query_id) WHERE arm = '{arm}' AND rank = 1 AND source_row % 6 = 0", f"{arm}: w__generated_answer": n(5), f"{arm}: w__generation_error": n(9), f"{arm}: j__score": n(8), f"{arm}: j__verdict": n(4)}


@query(_report({"tables": "SELECT 1", "forbidden_columns": "SELECT 2", **_packaged("bm25"), **_packaged("bm25_flat"), "bm25_flat: questions": "SELECT 2 * count(*) FROM q WHERE source_row % 3 = 0"}))
def dq_package(spark: SparkSession, sf: str) -> DataFrame:
    row, plant = F.col("source_row"), lambda n, bad, good: F.when(F.col("source_row") % n == 0, bad).otherwise(good)
    frames = {}
    for arm in ("bm25", "bm25_flat"):
        r = fixtures.results(spark, sf, arm).withColumns({"question": plant(7, " ", F.col("question")), "retrieval_error": plant(11, "boom", ""), "retrieved_items": F.when(row % 6 == 0, F.transform("retrieved_items", lambda x: x.withField("text", F.when(x["rank"] == 1, " NaN").otherwise(x["text"])))).otherwise(F.col("retrieved_items")),
                                                          "w__generated_answer": plant(5, " ", "a"), "w__generation_error": plant(9, "x", ""), "j__score": F.when(row % 8 == 0, 6).when(row % 5 != 0, 3).cast("int"), "j__judge_fallback": F.when(row % 5 == 0, "filter").otherwise(""), "j__verdict": plant(4, "", "CORRECT"), "parsed_label": F.lit("")})
        frames[arm] = r.withColumn("arm", plant(10, "other", F.lit(arm))) if arm == "bm25" else r.withColumn("query_id", F.when(row % 3 != 0, F.col("query_id")))
    return checks.package(frames, {"bm25": 7, "bm25_flat": 7, "neural": 7}, known_errors={"bm25": 2, "bm25_flat": 2})


@query(_report({"development_rows": "SELECT greatest(1000000 - count(*) - count(*) FILTER (source_row % 9 = 0), 0) FROM q WHERE split = 'dev'", "other_method": "SELECT count(*) + count(*) FILTER (source_row % 9 = 0) FROM q WHERE source_row % 6 = 0", "error": "SELECT count(*) + count(*) FILTER (source_row % 9 = 0) FROM q WHERE source_row % 10 = 0", "unique_query_id": "SELECT count(*) FROM q WHERE source_row % 9 = 0"}))
def dq_development(spark: SparkSession, sf: str) -> DataFrame:
    q, row = fixtures.passages(spark, sf), F.col("source_row")
    q = q.withColumns({"retrieval_method": F.when(row % 6 != 0, "bm25"), "retrieval_error": F.when(row % 10 == 0, "boom")})
    return checks.development(q.unionByName(q.where("source_row % 9 = 0")), "bm25", 1000000)


# remote services, archives, footers ----------------------------------------------------------------------


@query("SELECT doc_id, unit_id, sha256(text) AS text_sha256 FROM d")
def remote_units(spark: SparkSession, sf: str) -> DataFrame:
    """The units of a level through SQL: the level is a filter of the database, whose rows come in eight parts."""
    units = remote.sql_units(spark, "quillon.plans.fixtures:database", sf, "document", partitionColumn="doc_key", numPartitions=8)
    return units.select("doc_id", "unit_id", T.sha256(F.col("text")).alias("text_sha256"))


_SEARCHED = "SELECT al.query_id, d.doc_id, d.text, len(list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z]+')), lambda w: contains(lower(d.text), w))) AS score FROM al JOIN q USING (query_id) JOIN d USING (doc_id)"


@query(f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id AS unit_id, CAST(score AS DOUBLE) AS score, sha256(text) AS text_sha256 FROM ({_SEARCHED}) QUALIFY rank <= 4")
def searched_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The four best hits of a search service for every question, a task for each page of questions."""
    q = fixtures.questions(spark, sf).select("query_id", "question", "allowed_doc_ids")
    asked = scratch.kept(q).inputFiles()[0].rpartition("/")[0]
    hits = remote.search_hits(spark, asked, "quillon.plans.fixtures:search", sf)
    rows = pipelines.retrieve_searched(q, hits, "search").select("query_id", F.explode("retrieved_items").alias("i"))
    return rows.select("query_id", F.col("i.rank").cast("long").alias("rank"), "i.unit_id", "i.score", T.sha256(F.col("i.text")).alias("text_sha256"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS \"key\", c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier")
def archive_members(spark: SparkSession, sf: str) -> DataFrame:
    path = fixtures.archive_of_names(spark, sf)
    return archives.archive(spark, path, {"data/customer.parquet": "parquet", "data/supplier.csv.gz": "csv.gz"}).select("key", "name", "segment")


_FOOTED = {"orders": "o_orderkey", "customer": "c_custkey", "documents": "doc_id", "embeddings": "vec_id"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, count(*) - count({c}) AS nulls, min({c}) AS least, max({c}) AS greatest FROM {t}" for t, c in _FOOTED.items()))
def parquet_footers(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, nulls and the ends of key columns, from the footers of the tables' files."""
    found = archives.footers(spark, *[f"{sf}/{t}.parquet" for t in _FOOTED]).where(F.col("column").isin(*_FOOTED.values()))
    name = F.regexp_extract("path", r"/([a-z]+)\.parquet", 1)
    return found.groupBy(name.alias("name")).agg(F.sum("rows").alias("n_rows"), F.sum("nulls").alias("nulls"), F.min(F.col("least").cast("long")).alias("least"), F.max(F.col("greatest").cast("long")).alias("greatest"))
