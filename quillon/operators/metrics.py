"""Retrieval and judgment metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import substring
from quillon.operators.ranking import allowances, with_cumulative_tokens


def normalized_text(df: DataFrame) -> Column:
    """The column ``norm`` of a table that has it, else its text, normalized."""
    return F.col("norm") if "norm" in df.columns else T.normalized(F.col("text"))


def count_if(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


def _contexts(results: DataFrame, name: str, top_k: int) -> DataFrame:
    """``results`` with the tokens of the context up to each rank, and ``_own``: whether the run has contexts of its own.

    A run's ``containment_context_k`` that isn't null stands for the first k excerpts; runs without the column, or with a null there, have their
    excerpts joined.
    """
    df = with_cumulative_tokens(results, name, top_k=top_k)
    given = [c for k in range(1, top_k + 1) if (c := f"containment_context_{k}") in results.columns]
    if not given:
        return df.withColumn("_own", F.lit(False))
    at = [F.get(name, F.lit(k - 1)) for k in range(1, top_k + 1)]
    used = [F.when(F.col(c).isNotNull(), T.tokens(F.col(c))).otherwise(at[k]) if (c := f"containment_context_{k + 1}") in given else at[k] for k in range(top_k)]
    return df.withColumns({"_own": F.coalesce(*given).isNotNull(), name: F.array(*used)})


def containment(results: DataFrame, gold: str = "golden_answer", top_k: int = 4) -> DataFrame:
    """``results`` with exact_k for each k: whether the context up to rank k holds the gold answer."""
    df = _contexts(results.withColumn("_g", T.tokens(F.col(gold))), "_c", top_k)
    flags = {f"exact_{k}": T.holds(F.array_join("_g", " "), F.array_join(F.get("_c", F.lit(k - 1)), " ")) for k in range(1, top_k + 1)}
    return df.withColumns(flags).drop("_g", "_c", "_own")


def _bigrams(t: Column) -> Column:
    return F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat_ws(" ", F.get(t, i - 1), F.get(t, i)))).otherwise(F.array().cast("array<string>"))


def relaxed(results: DataFrame, gold: str = "golden_answer", top_k: int = 4, max_missing: int = 1) -> DataFrame:
    """relaxed_k flags by bigram counts: one join on (query, bigram), whatever the texts' length.

    Each excerpt's bigrams are exploded once, with its rank; a bigram over the border of two excerpts belongs to the later one. Those
    that the gold answer lacks meet no partner in the join, before anything is counted. Contexts of a run's own need not extend each other and are exploded for each k.
    """
    texts = _contexts(results, "c", top_k).select("query_id", "arm", T.tokens(F.col(gold)).alias("g"), "c", "_own")
    want = texts.select("query_id", "arm", F.explode(_bigrams(F.col("g"))).alias("gram")).groupBy("query_id", "arm", "gram").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for k in range(1, top_k + 1):
        upto = F.get("c", F.lit(k - 1))
        before = F.size(F.get("c", F.lit(k - 2))) if k > 1 else F.lit(0)
        start = F.greatest(before, F.lit(1))  # the last token of the rank before
        fresh = F.slice(upto, start, F.greatest(F.size(upto) - start + 1, F.lit(0)))
        parts.append(F.struct(F.lit(k).alias("k"), F.when(F.col("_own"), upto).otherwise(fresh).alias("t")))
    have = texts.select("query_id", "arm", "_own", F.explode(F.array(*parts)).alias("p")).select("query_id", "arm", "_own", "p.k", F.explode(_bigrams(F.col("p.t"))).alias("gram"))
    met = have.join(want, ["query_id", "arm", "gram"]).groupBy("query_id", "arm", "gram", "n")
    met = met.agg(*[count_if(F.when(F.col("_own"), F.col("k") == k).otherwise(F.col("k") <= k)).alias(f"m{k}") for k in range(1, top_k + 1)])
    met = met.groupBy("query_id", "arm").agg(*[F.sum(F.least("n", f"m{k}")).alias(f"m{k}") for k in range(1, top_k + 1)])
    slim = texts.select("query_id", "arm", F.size("g").alias("size"), *[F.array_contains(F.get("c", F.lit(k - 1)), F.get("g", F.lit(0))).alias(f"one{k}") for k in range(1, top_k + 1)])
    out = slim.join(met, ["query_id", "arm"], "left")
    flag = lambda k: F.when(F.col("size") == 0, False).when(F.col("size") == 1, F.col(f"one{k}")).otherwise(F.col("size") - 1 - F.coalesce(f"m{k}", F.lit(0)) <= max_missing)
    return out.select("query_id", "arm", *[flag(k).alias(f"relaxed_{k}") for k in range(1, top_k + 1)])


def full_document(questions: DataFrame, documents: DataFrame, gold: str = "golden_answer", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(query_id, exact_full): whether the allowed documents' texts, joined in the order allowed, hold the gold answer.

    Documents that hold it are found by keys (``substring.containing``), whatever a question allows. Only where none of these is allowed, allowed documents are
    looked at one by one, cut to two ends of the longest such answer's length: a border inside the answer leaves documents that end with its first
    tokens, begin with its last or lie between two of its spaces, and only their ends are gathered for a question. ``keep`` may write the
    texts that come without ``norm``, the pairs that keys find, and the answers that no document holds.
    """
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), normalized_text(documents).alias("norm"))
    docs = docs if "norm" in documents.columns else keep(docs)
    wanted = questions.select("query_id", T.normalized(F.col(gold)).alias("g")).where("g <> ''")
    held = substring.containing(wanted.toDF("needle_id", "needle"), docs.toDF("text_id", "text"), keep=keep).toDF("query_id", "doc_id")
    inside = held.join(allowances(questions), ["query_id", "doc_id"], "left_semi").select("query_id").distinct()
    lacking = keep(wanted.join(inside, "query_id", "left_anti"))
    longest = lacking.agg(F.max(F.length("g")).alias("longest")).where("longest > 0")  # one row, none where nothing lacks: then no text is read
    ends = F.when(F.length("norm") > 2 * F.col("longest"), F.concat(F.expr("left(norm, longest)"), F.lit("\u0000"), F.expr("right(norm, longest)"))).otherwise(F.col("norm"))
    cut = docs.crossJoin(F.broadcast(longest)).select("doc_id", ends.alias("t"))
    parts = allowances(questions.join(lacking.select("query_id"), "query_id", "left_semi")).join(cut, "doc_id", "left").join(lacking, "query_id")
    # a document that isn't there has no text and parts nothing
    parts = parts.where(F.col("t").isNull() | _at_border(F.col("g"), F.col("t"))).groupBy("query_id", "g").agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("x"))
    before = lambda x, i: F.when((i > 0) & (x["ord"] - F.get("x", i - 1)["ord"] <= 1), F.when(x["t"].isNull(), "").otherwise(" ")).otherwise("\u0000")
    joined = F.array_join(F.transform("x", lambda x, i: F.concat(before(x, i), F.coalesce(x["t"], F.lit("")))), "")
    across = parts.where(T.holds(F.col("g"), joined)).select("query_id")
    found = inside.union(across).withColumn("exact_full", F.lit(True))
    return questions.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("exact_full", F.lit(False)).alias("exact_full"))


def _at_border(g: Column, t: Column) -> Column:
    """Whether a normalized text can be next to a border inside ``g``: it ends with some first tokens, begins with some last ones, or is whole tokens between two spaces."""
    words, n = F.split(g, " ", -1), F.size(F.split(g, " ", -1))
    spaced = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    # its own first or last token tells for most texts, without a look at each border
    may = F.contains(spaced(g), spaced(F.substring_index(t, " ", -1))) | F.contains(spaced(g), spaced(F.substring_index(t, " ", 1))) | F.endswith(t, F.substring_index(g, " ", 1)) | F.startswith(t, F.substring_index(g, " ", -1))
    at = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.endswith(t, F.array_join(F.slice(words, F.lit(1), k), " ")) | F.startswith(t, F.array_join(F.slice(words, k + 1, n), " ")))
    return (t != "") & (n > 1) & may & (at | F.contains(spaced(g), spaced(t)))


def curve(flags: DataFrame, full: DataFrame, top_k: int = 4) -> DataFrame:
    """Per arm: questions, hits at each k, the ceiling, and hits over the ceiling (null without one)."""
    df = flags.join(full, "query_id", "left")
    aggs = [F.count(F.lit(1)).alias("n_questions"), count_if(F.col("exact_full")).alias("n_ceiling"), *[count_if(F.col(f"exact_{k}")).alias(f"hits_{k}") for k in range(1, top_k + 1)]]
    out = df.groupBy("arm").agg(*aggs)
    return out.withColumns({f"share_{k}": F.try_divide(F.col(f"hits_{k}").cast("double"), F.col("n_ceiling")) for k in range(1, top_k + 1)})


def presence_means(flags: DataFrame, *keys: str, top_k: int = 4) -> DataFrame:
    """Per key: questions, errors of the retrieval, and of each flag exact_k, relaxed_k and exact_full the share that holds; what the table lacks is left out."""
    names = [n for n in [f"{kind}_{k}" for kind in ("exact", "relaxed") for k in range(1, top_k + 1)] + ["exact_full"] if n in flags.columns]
    errors = [count_if(F.coalesce("retrieval_error", F.lit("")) != "").alias("retrieval_errors")] if "retrieval_error" in flags.columns else []
    return flags.groupBy(*keys).agg(F.countDistinct("query_id").alias("n_questions"), *errors, *[F.avg(F.col(n).cast("int")).alias(f"mean_{n}") for n in names])


def recall_hit(ranked: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(arm, k, recall, hit, n_questions): macro means over the questions with relevant units; null without any.

    ``ranked(query_id, arm, rank, unit_id)``, ``qrels(query_id, unit_id)``.
    """
    gold = qrels.select("query_id", "unit_id").distinct()
    n_gold = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    arms = ranked.select("arm").distinct()
    found = ranked.join(gold, ["query_id", "unit_id"], "left_semi").select("arm", "query_id", "unit_id", F.explode(F.filter(F.array(*map(F.lit, cutoffs)), lambda k: k >= F.col("rank"))).alias("k"))
    found = found.groupBy("arm", "query_id", "k").agg(F.countDistinct("unit_id").alias("n_found"))
    grid = arms.withColumn("k", F.explode(F.array(*map(F.lit, cutoffs))))
    scored = found.join(n_gold, "query_id").groupBy("arm", "k").agg(F.sum(F.col("n_found") / F.col("n_gold")).alias("r"), F.count(F.lit(1)).alias("h"))
    total = n_gold.agg(F.count(F.lit(1)).alias("n_questions"))
    out = grid.join(scored, ["arm", "k"], "left").crossJoin(F.broadcast(total))  # one row
    return out.select("arm", "k", F.try_divide(F.coalesce("r", F.lit(0.0)), F.col("n_questions")).alias("recall"), F.try_divide(F.coalesce("h", F.lit(0)).cast("double"), F.col("n_questions")).alias("hit"), "n_questions")


def substring_qrels(questions: DataFrame, units: DataFrame, least_tokens: int = 4, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(query_id, unit_id, doc_id, relevance, evidence): units of allowed documents that lie in the gold answer or hold it.

    Units of fewer tokens count for nothing; an empty gold answer lies in every unit. ``evidence`` is the gold answer. Questions without
    the column ``allowed_doc_ids`` allow everything. Pairs come from the rarest run of tokens of whichever text lies in the other
    (``substring.containing``), so those that are compared are about as many as those that are found. ``keep`` may write the pairs, and the units
    that are as short as a gold answer and have the first run inside them in common with one.
    """
    u = units.select("unit_id", F.col("doc_id").cast("string").alias("doc_id"), normalized_text(units).alias("u")).where((F.col("u") != "") & (F.size(F.split("u", " ")) >= least_tokens))
    gold = questions.select("query_id", T.normalized(F.col("golden_answer")).alias("g"))
    named = lambda df, i, x, to: df.select(F.col(i).alias(f"{to}_id"), F.col(x).alias(to))
    pairs = substring.containing(named(gold, "query_id", "g", "needle"), named(u, "unit_id", "u", "text"), keep=keep).toDF("query_id", "unit_id")
    # a unit that lies in a gold answer is no longer than the longest
    longest = gold.agg(F.coalesce(F.max(F.length("g")), F.lit(0)).alias("longest"))  # one row
    short = u.crossJoin(F.broadcast(longest)).where(F.length("u") <= F.col("longest"))
    small = keep(substring.possible(named(short, "unit_id", "u", "needle"), named(gold, "query_id", "g", "text")))
    inside = substring.containing(small, named(gold, "query_id", "g", "text"), keep=keep).select(F.col("text_id").alias("query_id"), F.col("needle_id").alias("unit_id"))
    rows = u.select("unit_id", "doc_id").join(keep(pairs.unionByName(inside).distinct()), "unit_id")
    if "allowed_doc_ids" in questions.columns:
        rows = rows.join(allowances(questions), ["query_id", "doc_id"], "left_semi")
        open_to = allowances(questions.where(T.normalized(F.col("golden_answer")) == "")).select("query_id", "doc_id").distinct()
        rows = rows.unionByName(open_to.hint("merge").join(u.select("unit_id", "doc_id"), "doc_id").select(*rows.columns))
    else:
        empty = gold.where("g = ''").select("query_id")
        rows = rows.unionByName(u.select("unit_id", "doc_id").crossJoin(empty).select(*rows.columns))  # each such question finds all units
    rows = rows.dropDuplicates(["query_id", "unit_id"]).join(questions.select("query_id", F.col("golden_answer").alias("evidence")), "query_id")
    return rows.select("query_id", "unit_id", "doc_id", F.lit(1).alias("relevance"), "evidence")


def judge_summary(judgments: DataFrame, *keys: str) -> DataFrame:
    """Per key: rows, errors, fallbacks, accuracy over judged rows, mean of scores that aren't null, histogram 1..5, tokens."""
    ok = F.coalesce("judge_error", F.lit("")) == ""
    score = T.as_number(F.col("score"))
    return judgments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), count_if(~ok).alias("n_errors"), count_if(F.coalesce("judge_fallback", F.lit("")) != "").alias("n_fallbacks"),
        F.avg(F.when(ok & (F.col("verdict") != ""), F.when(F.col("verdict") == "CORRECT", 1.0).otherwise(0.0))).alias("accuracy"),
        F.avg(F.when(ok, score)).alias("mean_score"), F.count(F.when(ok, score)).alias("n_scored"), count_if(ok & score.isNull()).alias("n_ignored"),
        *[count_if(ok & (score == k)).alias(f"score_{k}") for k in range(1, 6)], F.sum("judge_total_tokens").alias("judge_total_tokens"),
    )


def failures_as_one(judgments: DataFrame, tag: str = "failed_as_1") -> DataFrame:
    """Failed judgments become score 1 with a fallback tag, as one judge's policy has it."""
    failed = F.coalesce("judge_error", F.lit("")) != ""
    return judgments.withColumns({"score": F.when(failed, F.lit(1)).otherwise(F.col("score")), "judge_fallback": F.when(failed, F.lit(tag)).otherwise(F.col("judge_fallback")), "judge_error": F.lit("")})


def combined(summary: DataFrame, arms: list[str], metric: str, *keys: str) -> DataFrame:
    """One metric of a long summary with the arms as columns; cells that lack are null."""
    return summary.groupBy(*keys).pivot("arm", arms).agg(F.first(metric))


def label_summary(generations: DataFrame, *keys: str) -> DataFrame:
    return generations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), count_if(F.coalesce("generation_error", F.lit("")) != "").alias("n_errors"), F.avg(F.col("parsed_label").isNotNull().cast("int")).alias("parse_rate"), F.avg(F.coalesce(F.col("parsed_label") == F.col("golden_answer"), F.lit(False)).cast("int")).alias("label_accuracy"))


def generation_summary(generations: DataFrame, *keys: str) -> DataFrame:
    """Per key: questions, errors, answers that are blank, refusals for want of a context (no tokens sent), tokens."""
    failed = F.coalesce("generation_error", F.lit("")) != ""
    return generations.groupBy(*keys).agg(F.count(F.lit(1)).alias("questions"), count_if(failed).alias("generation_errors"), count_if(T.is_blank(F.coalesce("generated_answer", F.lit("")))).alias("n_blank"),
                                          count_if(~failed & (F.col("input_tokens") == 0)).alias("n_unsent"), F.sum("total_tokens").alias("total_tokens"))
