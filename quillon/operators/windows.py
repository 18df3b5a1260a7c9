"""Neighbour windows around ranked sentences.

Tables: ``sentences(doc_id, sentence_ordinal, paragraph_idx, sentence_idx, text)``,
``anchors(query_id, rank, doc_id, paragraph_idx, sentence_idx)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

GAP = "[...]"


def expand(anchors: DataFrame, sentences: DataFrame, radius: int = 2) -> DataFrame:
    """(query_id, rank, doc_id, position, text, is_first): sentences up to ``radius`` from an anchor in its document.

    Positions are dense in a document; windows are cut at its ends. is_first marks the best-ranked
    window of a question that has the sentence. The range is spelled out as equal keys, so the
    join needs no comparison of neighbours.
    """
    place = Window.partitionBy("doc_id").orderBy("sentence_ordinal")
    # only documents with an anchor are put in order
    lines = sentences.join(anchors.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("position", F.row_number().over(place))
    at = anchors.join(lines.select("doc_id", "paragraph_idx", "sentence_idx", "position"), ["doc_id", "paragraph_idx", "sentence_idx"])
    near = at.select("query_id", "rank", "doc_id", F.explode(F.sequence(F.col("position") - radius, F.col("position") + radius)).alias("position"))
    out = near.join(lines.select("doc_id", "position", "text"), ["doc_id", "position"])
    best = Window.partitionBy("query_id", "doc_id", "position").orderBy("rank")
    return out.withColumn("is_first", F.row_number().over(best) == 1).select("query_id", "rank", "doc_id", "position", "text", "is_first")


def duplicates_dropped(windows: DataFrame) -> DataFrame:
    return windows.groupBy("query_id").agg(F.sum((~F.col("is_first")).cast("int")).cast("long").alias("n_dropped"), F.sum(F.col("is_first").cast("int")).cast("long").alias("n_kept"))


def rendered(windows: DataFrame, by_rank: bool, gap: str | None = GAP) -> DataFrame:
    """One text per question, and per rank if ``by_rank``, of the sentences kept, in source order.

    Between sentences that aren't neighbours stands ``gap``; with None nothing does.
    """
    keys = ["query_id", "rank"] if by_rank else ["query_id"]
    line = Window.partitionBy(*keys).orderBy("doc_id", "position")
    kept = windows.where("is_first").withColumn("before", F.lag(F.struct("doc_id", "position")).over(line))
    jump = F.col("before").isNotNull() & ~((F.col("before.doc_id") == F.col("doc_id")) & (F.col("before.position") + 1 == F.col("position")))
    piece = F.when(jump & F.lit(gap is not None), F.concat(F.lit((gap or "") + " "), F.col("text"))).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "position", piece.alias("text"))))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("window_text"), F.count(F.lit(1)).alias("n_sentences"))


def anchor_faults(anchors: DataFrame, sentences: DataFrame, top_k: int = 4, questions: DataFrame | None = None) -> DataFrame:
    """(query_id, problem): ranks other than 1..k, several documents, a sentence that isn't there, or, with ``questions``, a document that the question doesn't allow."""
    by = anchors.groupBy("query_id").agg(F.array_sort(F.collect_list(F.col("rank").cast("int"))).alias("ranks"), F.countDistinct("doc_id").alias("docs"))
    wrong = by.where(F.col("ranks") != F.array(*[F.lit(k) for k in range(1, top_k + 1)])).select("query_id", F.lit("ranks").alias("problem"))
    many = by.where("docs > 1").select("query_id", F.lit("documents").alias("problem"))
    lost = anchors.join(sentences, ["doc_id", "paragraph_idx", "sentence_idx"], "left_anti").select("query_id", F.lit("no sentence").alias("problem")).distinct()
    faults = wrong.union(many).union(lost)
    if questions is None:
        return faults
    allowed = questions.select("query_id", F.explode("allowed_doc_ids").alias("doc_id")).select("query_id", F.col("doc_id").cast("string").alias("doc_id"))
    used = anchors.select("query_id", F.col("doc_id").cast("string").alias("doc_id"))
    return faults.union(used.join(allowed, ["query_id", "doc_id"], "left_anti").select("query_id", F.lit("document not allowed").alias("problem")).distinct())


def of_hits(hits: DataFrame) -> DataFrame:
    """Windows that a search gives with its sentences: (query_id, rank, doc_id, unit_id, score, text, n_units).

    ``hits(query_id, rank, doc_id, unit_id, score, text, context)``, where ``context`` is an array of (unit_id, text); a hit without one
    is its own window. A unit stays in the best-ranked window that has it; the rest of a window is joined without a mark, also where
    nothing stays. Equal units within a window count once.
    """
    own = F.array(F.struct("unit_id", "text"))
    units = F.when(F.coalesce(F.size("context"), F.lit(0)) > 0, F.col("context")).otherwise(own)
    each = hits.select("query_id", "rank", F.posexplode(units).alias("at", "u")).select("query_id", "rank", "at", "u.unit_id", "u.text")
    best = Window.partitionBy("query_id", "unit_id").orderBy("rank", "at")
    fresh = each.withColumn("n", F.row_number().over(best)).where("n = 1").groupBy("query_id", "rank").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("kept"))
    text = F.array_join(F.transform("kept", lambda x: F.coalesce(x["text"], F.lit(""))), "")
    out = hits.drop("text", "context").join(fresh, ["query_id", "rank"], "left")
    return out.select("query_id", "rank", "doc_id", "unit_id", "score", F.coalesce(T.stripped(text), F.lit("")).alias("text"), F.coalesce(F.size("kept"), F.lit(0)).alias("n_units"))
