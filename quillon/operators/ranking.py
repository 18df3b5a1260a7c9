"""Ranking of retrieval units for questions, each restricted to the documents it allows.

Tables: ``units(unit_id, doc_id, text, ...)``, ``questions(query_id, question, allowed_doc_ids, ...)``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T


def worded(units: DataFrame) -> DataFrame:
    """``units`` with the normalized text ``norm`` and its ``length`` in tokens in place of the text, to be written and read often."""
    df = units.withColumn("tokens", T.tokens(F.col("text")))
    return df.select(*[c for c in units.columns if c != "text"], F.array_join("tokens", " ").alias("norm"), F.size("tokens").alias("length"))


def tokens_of(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " ", -1))


def tokenized(units: DataFrame) -> DataFrame:
    """(unit_id, doc_id, tokens, length) of units with text, or of those of ``worded``: what ranking needs, text left behind."""
    if "norm" in units.columns:
        return units.select("unit_id", F.col("doc_id").cast("string").alias("doc_id"), tokens_of(F.col("norm")).alias("tokens"), "length")
    df = units.select("unit_id", F.col("doc_id").cast("string").alias("doc_id"), T.tokens(F.col("text")).alias("tokens"))
    return df.withColumn("length", F.size("tokens"))


def corpus_stats(tokenized_units: DataFrame) -> DataFrame:
    """One row: n units, avgdl (0 for an empty corpus)."""
    return tokenized_units.agg(F.count(F.lit(1)).alias("n_units"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))


def document_frequency(tokenized_units: DataFrame) -> DataFrame:
    """(token, df): in how many units a token occurs."""
    return tokenized_units.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def term_frequency(tokenized_units: DataFrame) -> DataFrame:
    """(unit_id, token, tf)."""
    return tokenized_units.select("unit_id", F.explode("tokens").alias("token")).groupBy("unit_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def bm25(questions: DataFrame, units: DataFrame, top_k: int = 4, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best ``top_k`` allowed units of each question: (query_id, rank, unit_id, doc_id, score)."""
    return bm25_arms(questions, units, {"bm25": b}, top_k, k1).drop("arm")


#: Allowed documents up to so many are sent to every task; with more, units go to their documents.
FEW = 20_000
#: About so many units share a block of postings.
BLOCK = 512
#: A question's threshold comes from its rarest tokens, which together occur in about so many units.
SEEDS = 16_384
#: Bounds may miss by what the order of a sum changes, and scores are compared to nine digits.
SLACK = 1e-6


class Index(NamedTuple):
    """What a ranking reads: ``postings(token, block, unit_id, doc_id, w0, w1, ...)`` with a weight for each arm, ``frequent(token, df, idf)``
    without tokens of idf 0, ``bounds(token, block, m0, m1, ...)`` with the greatest weights of each block, and a function that scores chosen pairs."""

    postings: DataFrame
    frequent: DataFrame
    bounds: DataFrame
    exact: Callable[[DataFrame], DataFrame]


def indexed(words: DataFrame, asked: DataFrame, bs: list[float], k1: float = 1.2, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Index:
    """The postings of the tokens in ``asked(query_id, token)``, in blocks of units of similar length, so that a block's bounds are near its weights."""
    stats = corpus_stats(words)
    met = words.select("unit_id", "doc_id", "length", F.explode("tokens").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    postings = keep(met.groupBy("token", "unit_id", "doc_id", "length").agg(F.count(F.lit(1)).alias("tf")))
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))  # one row
    frequent = keep(df.select("token", "df", "avgdl", "n_units", F.greatest(F.log((F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0)).alias("idf")).where("idf > 0"))
    norm = lambda b: F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl"))
    weights = [(F.col("idf") * F.col("tf") * (k1 + 1) / norm(b)).alias(f"w{i}") for i, b in enumerate(bs)]
    # units of a length class are dealt out by hash; 16 classes or so hold nearly all units
    block = F.struct(F.floor(2 * F.log2(F.col("length") + 1)).alias("band"), F.pmod(F.xxhash64("unit_id"), F.ceil(F.col("n_units") / (16 * BLOCK))).alias("part"))
    weighed = postings.join(frequent, "token").select("token", block.alias("block"), "unit_id", "doc_id", *weights)
    bounds = weighed.groupBy("token", "block").agg(*[F.max(f"w{i}").alias(f"m{i}") for i in range(len(bs))])

    def exact(pairs: DataFrame) -> DataFrame:
        """(query_id, unit_id, doc_id, s0, s1, ...) of ``pairs(query_id, unit_id)``: the postings of all tokens, of these units only."""
        found = pairs.join(asked, "query_id").join(weighed, ["token", "unit_id"])
        return found.groupBy("query_id", "unit_id", "doc_id").agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(bs))])

    return Index(weighed, frequent, bounds, exact)


def thresholds(asked: DataFrame, index: Index, allowed: DataFrame | None, arms: int, top_k: int) -> DataFrame:
    """(query_id, t0, t1, ...): scores that ``top_k`` allowed units of the question reach at least; no row where that isn't known.

    A question's rarest tokens make most of a score and have the shortest postings: what they alone add up to is a lower bound.
    """
    before = Window.partitionBy("query_id").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    rare = asked.join(index.frequent.select("token", "df"), "token").withColumn("upto", F.coalesce(F.sum("df").over(before), F.lit(0))).where(F.col("upto") < SEEDS)
    sums = permitted(rare.select("query_id", "token").join(index.postings, "token"), allowed).groupBy("query_id", "unit_id").agg(*[F.sum(f"w{i}").alias(f"p{i}") for i in range(arms)])
    for i in range(arms):
        sums = sums.withColumn(f"n{i}", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(f"p{i}"))))
    return sums.groupBy("query_id").agg(*[F.max(F.when(F.col(f"n{i}") == top_k, F.col(f"p{i}"))).alias(f"t{i}") for i in range(arms)]).where("t0 IS NOT NULL")


def counted(tokens: str) -> Column:
    """(token, tf) of a sorted array of tokens that isn't empty: the lengths of its runs."""
    t, n = F.col(tokens), F.size(tokens)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
    ends = F.concat(F.slice(starts, 2, n), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(t, a).alias("token"), (b - a).alias("tf")))


def frequencies(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(token, df, n_units, avgdl) of the tokens in ``asked`` that occur, with the statistics of all units, in one pass over ``words``."""
    wanted = asked.select("token").union(asked.sparkSession.range(1).select(F.lit("").alias("token"))).distinct()  # no token is empty: this one stands for the unit
    each = words.select("length", F.explode(F.concat(F.array(F.lit("")), F.array_distinct("tokens"))).alias("token")).join(wanted, "token", "left_semi")
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("token") == "", F.col("length"))).alias("total"))
    stats = counts.where("total IS NOT NULL").select(F.col("df").alias("n_units"), (F.col("total").cast("double") / F.col("df")).alias("avgdl"))
    return counts.where("total IS NULL").select("token", "df").crossJoin(F.broadcast(stats))  # one row


def scored_where_allowed(units: DataFrame, asked: DataFrame, allowed: DataFrame, bs: list[float], k1: float, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(query_id, unit_id, doc_id, s0, s1, ...) of the allowed units with a match, and the units among which all allowed ones are.

    ``allowed(query_id, doc_id)`` may repeat rows. Where few documents are allowed, these are sent to every task and only their units are
    counted; with many, units are counted where they are read, and the counts of the questions' tokens go to the documents, no text. No
    posting is written, and units that no question allows only count in the statistics.
    """
    df = frequencies(tokenized(units), asked)
    idf = F.greatest(F.log((F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0))
    frequent = keep(df.select("token", "avgdl", idf.alias("idf")).where("idf > 0"))
    readers = keep(allowed.groupBy("doc_id").agg(F.collect_set("query_id").alias("readers")))
    few = readers.limit(FEW + 1).count() <= FEW
    mine = units.withColumn("doc_id", F.col("doc_id").cast("string"))
    if few:
        mine, readers = mine.join(F.broadcast(readers.select("doc_id")), "doc_id", "left_semi"), F.broadcast(readers)
    if "norm" not in units.columns:  # units that come as texts are tokenized once more, where few documents are allowed only theirs
        mine = keep(worded(mine.select("unit_id", "doc_id", "text"))) if few else worded(mine.select("unit_id", "doc_id", "text"))
    each = mine.where("length > 0").withColumn("t", F.sort_array(tokens_of(F.col("norm")))).select("unit_id", "doc_id", "length", F.explode(counted("t")).alias("p"))
    each = each.select("unit_id", "doc_id", "length", "p.token", "p.tf").join(frequent.select("token"), "token", "left_semi")
    each = each.join(readers if few else readers.hint("shuffle_hash"), "doc_id")
    norm = lambda b: F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl"))
    weights = [(F.col("idf") * F.col("tf") * (k1 + 1) / norm(b)).alias(f"w{i}") for i, b in enumerate(bs)]
    met = each.select("unit_id", "doc_id", "length", "token", "tf", F.explode("readers").alias("query_id")).join(asked.join(frequent, "token"), ["query_id", "token"])
    return met.select("unit_id", "doc_id", "query_id", *weights).groupBy("doc_id", "unit_id", "query_id").agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(bs))]), mine


def allowances(questions: DataFrame) -> DataFrame:
    """(query_id, ord, doc_id): what each question allows, a row a document, with its place.

    The planner takes lists of ids in a compressed table for as small as their file, and would gather millions of rows on the driver to send them
    to every task; so joins with them are sorted merges.
    """
    rows = questions.select("query_id", F.posexplode("allowed_doc_ids").alias("ord", "doc_id"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("string")).hint("merge")


def permitted(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Rows of units in documents that their question allows."""
    return rows if allowed is None else rows.join(allowed, ["query_id", "doc_id"], "left_semi")


def contenders(asked: DataFrame, index: Index, allowed: DataFrame | None, arms: int, top_k: int) -> DataFrame:
    """(query_id, unit_id): allowed units that can be among the best ``top_k`` in an arm.

    In each block a question's tokens are put in the order of their idf. As long as the greatest weights of the commonest ones
    add up to less than the threshold, no unit of the block gets there by these alone: their postings are passed over, and a block
    where that goes for all tokens isn't looked at. What the units found by the other tokens may still gain is bounded by the tokens
    passed over; those that can't reach the threshold with it go.
    """
    t = [F.coalesce(F.col(f"t{i}"), F.lit(0.0)) - SLACK for i in range(arms)]
    line = Window.partitionBy("query_id", "block").orderBy("idf", "token").rowsBetween(Window.unboundedPreceding, 0)
    bounds = asked.join(index.frequent.select("token", "idf"), "token").join(index.bounds, "token").join(thresholds(asked, index, allowed, arms, top_k), "query_id", "left")
    passed = F.lit(True)
    for i in range(arms):
        bounds = bounds.withColumn(f"r{i}", F.sum(f"m{i}").over(line))
        passed = passed & (F.col(f"r{i}") < t[i])
    whole = Window.partitionBy("query_id", "block")
    bounds = bounds.withColumn("passed", passed).withColumns({f"rest{i}": F.coalesce(F.max(F.when(passed, F.col(f"r{i}"))).over(whole), F.lit(0.0)) for i in range(arms)})
    needed = bounds.where(~F.col("passed")).select("query_id", "token", "block", *[f"rest{i}" for i in range(arms)], *[c.alias(f"t{i}") for i, c in enumerate(t)])
    found = permitted(needed.join(index.postings, ["token", "block"]), allowed)
    sums = found.groupBy("query_id", "unit_id").agg(*[(F.sum(f"w{i}") + F.first(f"rest{i}") - F.first(f"t{i}")).alias(f"over{i}") for i in range(arms)])
    return sums.where(F.greatest(*[F.col(f"over{i}") for i in range(arms)], F.lit(-1.0)) >= 0).select("query_id", "unit_id")


def bm25_arms(questions: DataFrame, units: DataFrame, arms: dict[str, float], top_k: int = 4, k1: float = 1.2, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The best ``top_k`` allowed units of each question and arm, an arm being a b: (query_id, arm, rank, unit_id, doc_id, score).

    Statistics are over all units, candidates only those of allowed documents; questions without the column ``allowed_doc_ids`` allow
    everything. A query's tokens count once. idf is floored at 0, so a term of more than half of the units adds
    nothing. Units without a match have score 0 and fill up; equal scores (to nine digits) go by unit_id. A question that allows
    nothing has no row.

    With ``allowed_doc_ids`` each unit is scored where its document is allowed (``scored_where_allowed``). Without, postings are cut down to the
    questions' vocabulary, a threshold for each question lets blocks and common tokens be passed over (``contenders``), and only contenders
    are scored in full. Each task sends on its best ``top_k`` of a question. Questions with
    fewer matches than ``top_k`` are filled up from the least unit ids. All arms share the joins. Units of ``worded`` aren't
    tokenized again. ``keep`` may write tables that are read several times (the questions' tokens, the frequencies, the readers of documents, the postings, the best hits).
    """
    n, words = len(arms), tokenized(units)
    asked = keep(questions.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("token")).distinct())
    allowed = None
    if "allowed_doc_ids" in questions.columns:
        allowed = questions.select("query_id", F.explode("allowed_doc_ids").alias("doc_id")).select("query_id", F.col("doc_id").cast("string").alias("doc_id"))
        hits, words = scored_where_allowed(units, asked, allowed, list(arms.values()), k1, keep)
    else:
        index = indexed(words, asked, list(arms.values()), k1, keep)
        hits = index.exact(contenders(asked, index, allowed, n, top_k))
    each = F.explode(F.array(*[F.struct(F.lit(arm).alias("arm"), F.col(f"s{i}").alias("score")) for i, arm in enumerate(arms)])).alias("x")
    order = Window.partitionBy("query_id", "arm").orderBy(F.round("score", 9).desc(), "unit_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "arm", "rank", "unit_id", "doc_id", "score")
    top = keep(best(hits.select("query_id", "unit_id", "doc_id", each).select("query_id", "x.arm", "unit_id", "doc_id", "x.score")))
    # every match of a question with fewer than top_k is in ``top``, in each arm
    fill = _fill(questions.select("query_id").distinct(), words, top.select("query_id", "unit_id").distinct(), allowed, top_k)
    fill = fill.select("query_id", F.explode(F.array(*map(F.lit, arms))).alias("arm"), "unit_id", "doc_id", F.lit(0.0).alias("score"))
    return best(top.drop("rank").unionByName(fill))


def _fill(ids: DataFrame, words: DataFrame, hits: DataFrame, allowed: DataFrame | None, top_k: int) -> DataFrame:
    """(query_id, unit_id, doc_id) of units without a match, the least ids first, for questions that match fewer than ``top_k``."""
    lacking = ids.join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= top_k), "query_id", "left_anti")
    least = words.select("unit_id", "doc_id")
    if allowed is None:  # fewer than top_k match, so twice as many ids are enough for any question
        rows = lacking.crossJoin(F.broadcast(least.orderBy("unit_id").limit(2 * top_k)))
    else:
        rows = allowed.join(lacking, "query_id", "left_semi").distinct().join(least, "doc_id").select("query_id", "unit_id", "doc_id")
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("unit_id"))).where(F.col("n") <= 2 * top_k).drop("n")
    return rows.join(hits.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_anti").select("query_id", "unit_id", "doc_id")


def with_text(ranked: DataFrame, units: DataFrame) -> DataFrame:
    """``ranked`` with the units' text, and their paragraph_idx and subparagraph_idx where they have such columns.

    Units that aren't ranked go before any text is shuffled.
    """
    texts = units.select("unit_id", "text", *[c for c in ("paragraph_idx", "subparagraph_idx") if c in units.columns])
    return ranked.join(texts.join(ranked.select("unit_id").distinct(), "unit_id", "left_semi"), "unit_id", "left")


def nested(questions: DataFrame, ranked_text: DataFrame, arm: str, **constants) -> DataFrame:
    """One row per question: arm, constants, retrieved_items in rank order (with the paragraph ids that ``ranked_text`` has), retrieved_count, retrieval_error."""
    extra = [c for c in ("paragraph_idx", "subparagraph_idx") if c in ranked_text.columns]
    item = F.struct(F.col("rank").cast("int").alias("rank"), "unit_id", "doc_id", "text", "score", *[F.col(c).cast("long").alias(c) for c in extra])
    items = ranked_text.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("retrieved_items"))
    kind = "array<struct<rank:int,unit_id:string,doc_id:string,text:string,score:double" + "".join(f",{c}:bigint" for c in extra) + ">>"
    out = questions.join(items, "query_id", "left").withColumn("retrieved_items", F.coalesce("retrieved_items", F.array().cast(kind)))
    out = out.withColumn("arm", F.lit(arm)).withColumn("retrieved_count", F.size("retrieved_items").cast("long")).withColumn("retrieval_error", F.lit(""))
    return out.withColumns({k: F.lit(v) for k, v in constants.items()})


def context(items="retrieved_items"):
    """The texts that aren't blank, in rank order, parted by an empty line."""
    return F.array_join(F.transform(F.filter(items, lambda x: ~T.is_blank(x["text"])), lambda x: x["text"]), "\n\n")


def cumulative(items="retrieved_items", top_k: int = 4):
    """For k from 1 to ``top_k``, the texts of the first k ranks joined by a space."""
    texts = F.transform(items, lambda x: F.coalesce(x["text"], F.lit("")))
    return F.array(*[F.array_join(F.slice(texts, 1, k), " ") for k in range(1, top_k + 1)])


def with_cumulative_tokens(df: DataFrame, name: str, items: str = "retrieved_items", top_k: int = 4) -> DataFrame:
    """``df`` with an array of the tokens of ``cumulative`` texts: no token spans a space, so each text is tokenized once."""
    df = df.withColumn("_each", F.transform(items, lambda x: T.tokens(x["text"])))
    none = F.array().cast("array<string>")
    return df.withColumn(name, F.array(*[F.coalesce(F.flatten(F.slice("_each", 1, k)), none) for k in range(1, top_k + 1)])).drop("_each")


def wide(df: DataFrame, top_k: int = 4) -> DataFrame:
    """Columns excerpt_k, with _unit_id, _doc_id (empty if absent) and _score (null if absent)."""
    columns = {}
    for k in range(1, top_k + 1):
        item = F.get("retrieved_items", F.lit(k - 1))
        columns |= {f"excerpt_{k}": F.coalesce(item["text"], F.lit("")), f"excerpt_{k}_unit_id": F.coalesce(item["unit_id"], F.lit("")), f"excerpt_{k}_doc_id": F.coalesce(item["doc_id"], F.lit("")), f"excerpt_{k}_score": item["score"]}
    return df.withColumns(columns).withColumn("retrieved_context", context())


def from_wide(df: DataFrame, top_k: int = 4) -> DataFrame:
    """retrieved_items from excerpt columns: blank ranks are left out, the others keep their rank."""
    columns = set(df.columns)
    of = lambda k, name, kind: (F.col(f"excerpt_{k}_{name}") if f"excerpt_{k}_{name}" in columns else F.lit(None)).cast(kind)
    items = F.array(*[F.struct(F.lit(k).alias("rank"), of(k, "unit_id", "string").alias("unit_id"), of(k, "doc_id", "string").alias("doc_id"), F.col(f"excerpt_{k}").alias("text"), of(k, "score", "double").alias("score")) for k in range(1, top_k + 1)])
    return df.withColumn("retrieved_items", F.filter(items, lambda x: ~T.is_blank(T.cleaned(x["text"]))))


def import_ranked(df: DataFrame, text_column: str, arm: str) -> DataFrame:
    """Rankings that come as one text with ellipsis lines between excerpts: one to four of them."""
    parts = F.filter(F.transform(T.excerpts(F.col(text_column)), T.stripped), lambda x: x != "")
    items = F.transform(parts, lambda x, i: F.struct((i + 1).cast("int").alias("rank"), F.lit(None).cast("string").alias("unit_id"), F.lit(None).cast("string").alias("doc_id"), x.alias("text"), F.lit(None).cast("double").alias("score")))
    fits = F.size(parts).between(1, 4)
    return df.withColumn("arm", F.lit(arm)).withColumn("retrieved_items", items).withColumn("retrieved_count", F.size(parts).cast("long")).withColumn("retrieval_error", F.when(fits, "").otherwise("excerpt count"))
