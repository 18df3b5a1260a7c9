"""Data-quality checks: each gives a frame of (check, n_violations); none of them collects rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.metrics import count_if
from quillon.operators.ranking import allowances
from quillon.sources.sinks import CheckFailed


def _row(name: str, n: DataFrame) -> DataFrame:
    return n.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n_violations"))


def require(report: DataFrame) -> DataFrame:
    """Raises if any check of ``report`` is violated; reports have a row a check."""
    bad = report.where("n_violations > 0").collect()
    if bad:
        raise CheckFailed(", ".join(f"{r['check']}: {r['n_violations']}" for r in bad))
    return report


def columns_present(df: DataFrame, columns: list[str]) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise CheckFailed(f"missing columns {missing}")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return _row("unique_" + "_".join(keys), df.groupBy(*keys).count().where("count > 1"))


def subset(name: str, rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return _row(name, rows.join(known, keys, "left_anti"))


def equal_sets(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, repeats counted, that one side has and the other lacks: both sides are read once and meet in one aggregation."""
    signed = a.withColumn("_n", F.lit(1)).unionAll(b.withColumn("_n", F.lit(-1)))
    return signed.groupBy(*a.columns).agg(F.abs(F.sum("_n")).alias("_n")).agg(F.lit(name).alias("check"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_violations"))


def listed(one: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """A one-row aggregate as a report."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), c.cast("long").alias("n_violations")) for n, c in counts.items()])).alias("r")).select("r.*")


def conditions(df: DataFrame, **violations: Column) -> DataFrame:
    """All row conditions in one pass; each argument is what must not be."""
    return listed(df.agg(*[count_if(c).alias(n) for n, c in violations.items()]), {n: F.col(f"`{n}`") for n in violations})


def together(*reports: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), reports)


def results(df: DataFrame, expected: int | DataFrame, partial: bool = False) -> DataFrame:
    """Retrieval results: row count (a number, or as many as a table has rows), unique keys, no nulls, at most four items."""
    columns_present(df, ["query_id", "question", "golden_answer", "retrieved_items", "retrieved_count"])
    n = df.agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("wanted", F.lit(expected)) if isinstance(expected, int) else n.crossJoin(expected.agg(F.count(F.lit(1)).alias("wanted")))  # one row each
    right = F.col("n").between(F.lit(1), F.col("wanted")) if partial else F.col("n") == F.col("wanted")
    count = n.select(F.lit("row_count").alias("check"), F.when(right, 0).otherwise(1).cast("long").alias("n_violations"))
    rows = conditions(df, null_key=F.col("query_id").isNull(), blank_question=T.is_blank(F.col("question")), null_answer=F.col("golden_answer").isNull(), too_many_items=F.size("retrieved_items") > 4, count_differs=F.size("retrieved_items") != F.col("retrieved_count"), error=F.coalesce("retrieval_error", F.lit("")) != "")
    return together(count, unique(df, ["query_id"]), rows)


def doc_filter(df: DataFrame, questions: DataFrame, units: DataFrame) -> DataFrame:
    """Every retrieved unit is known, and its document allowed for the question."""
    items = df.select("query_id", F.explode("retrieved_items").alias("i")).select("query_id", "i.unit_id", "i.doc_id")
    return together(subset("known_unit", items, units.select("unit_id"), ["unit_id"]), subset("allowed_document", items, allowances(questions), ["query_id", "doc_id"]))


def monotone(flags: DataFrame, top_k: int = 4) -> DataFrame:
    """A hit at k is a hit at k + 1."""
    return conditions(flags, **{f"monotone_{k}_{k + 1}": F.col(f"exact_{k}") & ~F.col(f"exact_{k + 1}") for k in range(1, top_k)})


def coverage(df: DataFrame, questions: DataFrame, arms: list[str]) -> DataFrame:
    """Each arm has exactly the questions' keys."""
    grid = questions.select("query_id").withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    have = df.select("query_id", "arm")
    return together(subset("missing_key", grid, have, ["query_id", "arm"]), subset("unknown_key", have, grid, ["query_id", "arm"]))


def judgments(df: DataFrame) -> DataFrame:
    """Verdicts and scores in their domains; a score lacks only with a fallback tag."""
    score, tag = T.as_number(F.col("score")), F.coalesce("judge_fallback", F.lit(""))
    return conditions(df, verdict=~F.coalesce("verdict", F.lit("")).isin("CORRECT", "INCORRECT", ""), score=score.isNotNull() & ~score.between(1, 5), score_missing=score.isNull() & (tag == ""), error=F.coalesce("judge_error", F.lit("")) != "")


def identities(df: DataFrame, **wanted: str) -> DataFrame:
    """A row of the report for each column: rows whose value isn't the one told, such as the model, its effort or the version of the prompt; null is none."""
    columns_present(df, list(wanted))
    return conditions(df, **{f"other_{c}": ~F.col(c).cast("string").eqNullSafe(F.lit(v)) for c, v in wanted.items()})


def outputs(work: DataFrame, generations: DataFrame, judged: DataFrame, writer: dict[str, str], judge: dict[str, str]) -> DataFrame:
    """Answers and judgments of one model: every question and arm once, of the identity told (``writer`` and ``judge`` map columns to values), without errors,
    blank answers or reasons, verdicts in their domain."""
    key, problem = ["query_id", "arm"], lambda c: F.coalesce(c, F.lit("")) != ""
    g = conditions(generations, generation_error=problem("generation_error"), blank_answer=T.is_blank(F.coalesce("generated_answer", F.lit(""))))
    j = conditions(judged, judge_error=problem("judge_error"), verdict=~F.coalesce("verdict", F.lit("")).isin("CORRECT", "INCORRECT"), blank_reason=T.is_blank(F.coalesce("reason", F.lit(""))))
    named = lambda report, side: report.withColumn("check", F.concat(F.lit(f"{side}_"), "check"))
    sides = []
    for side, df, told, report in (("generation", generations, writer, g), ("judgment", judged, judge, j)):
        sides.append(named(together(subset("missing", work, df, key), subset("unknown", df, work, key), unique(df, key), identities(df, **told), report), side))
    return together(*sides)


def summary_matches(summary: DataFrame, recomputed: DataFrame, keys: list[str], value: str, within: float = 1e-12) -> DataFrame:
    j = summary.alias("a").join(recomputed.alias("b"), keys, "full_outer")
    return _row(f"summary_{value}", j.where(~(F.abs(F.col(f"a.{value}") - F.col(f"b.{value}")) <= within) | F.col(f"a.{value}").isNull() | F.col(f"b.{value}").isNull()))


def same_except(a: DataFrame, b: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Variants of one table agree in all columns of ``same``."""
    return equal_sets("variants_agree", a.select(key, *same), b.select(key, *same))


def golden(actual: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Row counts by key equal the golden ones."""
    j = actual.alias("a").join(wanted.alias("b"), key, "full_outer")
    return _row("golden_counts", j.where(~F.col("a.n").eqNullSafe(F.col("b.n"))))


def size_limit(files: DataFrame, most: int = 49 << 20) -> DataFrame:
    return _row("size_limit", files.where(F.col("bytes") > most))


def handoff(rows: DataFrame, questions: DataFrame, units: DataFrame, arms: list[str], qrels: DataFrame | None = None) -> DataFrame:
    """Runs as they are handed over: exactly these arms, all questions in each and once, nothing null, known units, allowed
    documents, as many items as told, relevant units that are known and allowed, and flags (where the table has them) that rise with k."""
    needed = ["question", "golden_answer", "retrieval_error", "retrieved_count", "retrieved_items"]
    columns_present(rows, ["query_id", "arm", *needed])
    filled = F.size(F.filter("retrieved_items", lambda x: F.concat_ws("", x["unit_id"], x["doc_id"], x["text"]) != ""))
    bad = {**{f"null_{c}": F.col(c).isNull() for c in needed}, "count_differs": filled != F.col("retrieved_count")}
    if "exact_1" in rows.columns:
        bad |= {f"monotone_{k}_{k + 1}": F.col(f"exact_{k}") & ~F.col(f"exact_{k + 1}") for k in range(1, 4)}
    # all that hangs on keys and single rows in one pass: counts by key beside the keys that must be there
    by_key = rows.groupBy("query_id", "arm").agg(F.count(F.lit(1)).alias("n"), *[count_if(c).alias(k) for k, c in bad.items()])
    grid = questions.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted")).withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    both = by_key.join(grid, ["query_id", "arm"], "full_outer")
    there, wanted = F.col("n").isNotNull(), F.col("wanted").isNotNull()
    one = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"), count_if(F.col("n") > 1).alias("repeated"), F.sum(F.when(~there, F.col("wanted")).otherwise(0)).alias("missing"), F.sum(F.when(~wanted, F.col("n")).otherwise(0)).alias("unknown"),
                   F.countDistinct(F.when(there & ~F.coalesce(F.col("arm").isin(arms), F.lit(False)), F.coalesce("arm", F.lit("")))).alias("other_arms"), *[F.coalesce(F.max((there & (F.col("arm") == a)).cast("int")), F.lit(0)).alias(f"has_{i}") for i, a in enumerate(arms)], *[F.sum(k).alias(k) for k in bad])
    told = {"arms": F.col("other_arms") + sum((1 - F.col(f"has_{i}") for i in range(len(arms))), F.lit(0)), "row_count": (F.col("n") != F.col("wanted")).cast("long"), "unique_query_id_arm": F.col("repeated"), "missing_key": F.coalesce("missing", F.lit(0)), "unknown_key": F.coalesce("unknown", F.lit(0)), **{k: F.coalesce(k, F.lit(0)) for k in bad}}
    parts = [listed(one, told), doc_filter(rows, questions, units)]
    if qrels is not None:
        allowed = questions.select("query_id", F.explode("allowed_doc_ids").alias("doc_id"))
        parts += [subset("qrels_query", qrels, questions, ["query_id"]), subset("qrels_unit", qrels, units.select("unit_id"), ["unit_id"]), subset("qrels_document", qrels, allowed, ["query_id", "doc_id"])]
    return together(*parts)


def matrix(work: DataFrame, generations: DataFrame, judged: DataFrame, models: list[str], judges: list[str], prompt_version: str) -> DataFrame:
    """A paired matrix: inputs that agree over the arms; every cell of rows, models and judges there, once and without error;
    prompts of one version; contexts that hash to what was sent, judgments of what was generated, scores in their domain."""
    agree = work.groupBy("query_id").agg(F.countDistinct(F.struct("question", "golden_answer")).alias("n")).where("n > 1")
    cells = work.select("query_id", "arm", T.sha256(F.col("context")).alias("wanted")).withColumn("model", F.explode(F.array(*map(F.lit, models))))
    key = ["query_id", "arm", "model"]
    rows = conditions(generations, generation_error=F.coalesce("generation_error", F.lit("")) != "", blank_answer=T.is_blank(F.coalesce("generated_answer", F.lit(""))), prompt_version=~F.col("prompt_version").eqNullSafe(F.lit(prompt_version)))
    context = generations.join(cells, key).where(~F.col("retrieval_context_sha256").eqNullSafe(F.col("wanted")))
    j = judged.withColumnRenamed("generator", "model")
    made = generations.select(*key, F.col("generation_sha256").alias("wanted")).withColumn("judge_model", F.explode(F.array(*map(F.lit, judges))))
    other = j.join(made, [*key, "judge_model"]).where(~F.col("generation_sha256").eqNullSafe(F.col("wanted")))
    scale, score = F.col("judge_mode") != "binary", T.as_number(F.col("score"))
    domain = conditions(j, judge_error=F.coalesce("judge_error", F.lit("")) != "", verdict=~scale & ~F.coalesce("verdict", F.lit("")).isin("CORRECT", "INCORRECT"), score=scale & (F.coalesce("judge_fallback", F.lit("")) == "") & ~F.coalesce(score.between(1, 5), F.lit(False)), blank_reason=T.is_blank(F.coalesce("reason", F.lit(""))))
    return together(
        _row("inputs_agree", agree), unique(generations, key), subset("missing_generation", cells, generations, key), subset("unknown_generation", generations, cells, key), rows, _row("context_hash", context),
        unique(j, [*key, "judge_model"]), subset("missing_judgment", made, j, [*key, "judge_model"]), subset("unknown_judgment", j, made, [*key, "judge_model"]), _row("generation_hash", other), domain,
    )


#: Labels that a text parse gave are no published metric.
FORBIDDEN = ("parsed_label", "label_correct", "label_parse_error")


def package(tables: dict[str, DataFrame], wanted: dict[str, int], forbidden: tuple[str, ...] = FORBIDDEN, known_errors: dict[str, int] | None = None) -> DataFrame:
    """Wide results, a table an arm: exactly the tables and row counts wanted, one arm in each, no blank question or answer, no
    "nan" in place of a text, no forbidden column, errors empty (of retrieval as many as known), values in their domains, the same questions in all."""
    spark = next(iter(tables.values())).sparkSession
    names = sum(c.count(w) > 0 for df in tables.values() for c in df.columns for w in forbidden)
    parts = [spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.lit(v).cast("long").alias("n_violations")) for k, v in (("tables", len(set(tables) ^ set(wanted))), ("forbidden_columns", names))])).alias("r")).select("r.*")]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    frames, counts = [], {}
    for i, (name, df) in enumerate(tables.items()):
        bad = {"other_arm": ~F.col("arm").eqNullSafe(F.lit(name)), "blank_question": T.is_blank(text("question")), "nan_text": F.exists("retrieved_items", lambda x: F.lower(T.stripped(F.coalesce(x["text"], F.lit("")))) == "nan")}
        for c in df.columns:
            cell, _, field = c.rpartition("__")
            mode = F.coalesce(F.col(f"{cell}__judge_mode"), F.lit("")) if f"{cell}__judge_mode" in df.columns else F.lit("")
            if field in ("generation_error", "judge_error"):
                bad[c] = ~T.is_blank(text(c))
            elif field == "generated_answer":
                bad[c] = T.is_blank(text(c))
            elif field == "judge_correct":
                bad[c] = F.col(c).isNull()
            elif field == "score":
                tag = text(f"{cell}__judge_fallback") if f"{cell}__judge_fallback" in df.columns else F.lit("")
                number = T.as_number(F.col(c))
                bad[c] = (mode != "binary") & F.when(number.isNull(), tag == "").otherwise(~number.between(1, 5))
            elif field == "verdict":
                bad[c] = (mode != "scale-1-5") & ~text(c).isin("CORRECT", "INCORRECT")
        bad["retrieval_errors"] = ~T.is_blank(text("retrieval_error"))
        frames.append(df.select("query_id", F.lit(1).alias(f"n{i}"), *[v.cast("int").alias(f"n{i} {k}") for k, v in bad.items()]))
        rows, same = F.lit(wanted.get(name, -1)), {f"{name}: questions": F.col(f"differ{i}")} if i else {}
        counts |= {f"{name}: rows": (F.col(f"n{i}") != rows) | (F.col(f"ids{i}") != rows), **{f"{name}: {k}": F.col(f"`n{i} {k}`") for k in bad}, **same}
        counts[f"{name}: retrieval_errors"] = F.abs(F.col(f"`n{i} retrieval_errors`") - (known_errors or {}).get(name, 0))
    # each table is read once: flags and numbers of rows by question, then their sums
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    flags = [c for c in stacked.columns if c != "query_id"]
    by_question = stacked.groupBy("query_id").agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in flags])
    n = range(len(frames))
    one = by_question.agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in flags], *[count_if((F.col(f"n{i}") > 0) & F.col("query_id").isNotNull()).alias(f"ids{i}") for i in n], *[F.coalesce(F.sum(F.abs(F.col(f"n{i}") - F.col("n0"))), F.lit(0)).alias(f"differ{i}") for i in n])
    return together(*parts, listed(one, counts))


def development(frame: DataFrame, method: str, size: int) -> DataFrame:
    """Preconditions of a frozen run: one method, no errors, unique ids, at least ``size`` development rows."""
    enough = frame.agg(F.lit("development_rows").alias("check"), F.greatest(F.lit(size) - count_if(F.lower("split") == "dev"), F.lit(0)).alias("n_violations"))
    rows = conditions(frame, other_method=~F.col("retrieval_method").eqNullSafe(F.lit(method)), error=F.coalesce("retrieval_error", F.lit("")) != "")
    return together(enough, rows, unique(frame, ["query_id"]))
