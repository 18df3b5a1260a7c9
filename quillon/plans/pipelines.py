"""The commands of an evaluation, composed of the operators: each takes frames or paths and gives frames."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions import text as T
from quillon.operators import assemble, checks, metrics, paired, ranking, sampling, windows
from quillon.plans import answers
from quillon.sources import archives, scratch, sinks, tables
from quillon.streaming import attempts


def prepare_questions(queries: DataFrame, sources: DataFrame, allowed: DataFrame, dataset: str) -> DataFrame:
    """Questions from three tables with one row a query, except ``allowed(query_id, ord, doc_id)``."""
    checks.require(checks.together(checks.unique(queries, ["query_id"]), checks.unique(sources, ["query_id"]), checks.subset("source_known", queries, sources, ["query_id"])))
    docs = assemble.ordered_list(allowed, "query_id", "ord", "doc_id", "allowed_doc_ids")
    df = queries.join(sources, "query_id", "left").join(docs, "query_id", "left").withColumn("dataset", F.lit(dataset))
    first = ["query_id", "split", "source_row", "question", "golden_answer", "allowed_doc_ids", "dataset"]
    return df.select(*first, *[c for c in df.columns if c not in first])


def prepare_units(documents: DataFrame, level: str, id_columns: list[str]) -> DataFrame:
    """retrieval_level, doc_id, unit_id, text and the id columns, whatever the source calls its ids."""
    return documents.select(F.lit(level).alias("retrieval_level"), F.col("doc_id").cast("string").alias("doc_id"), T.compound_id(*[F.col(c) for c in id_columns]).alias("unit_id"), "text", *[c for c in id_columns if c != "doc_id"])


def positional_qrels(questions: DataFrame, source: DataFrame, evidence: DataFrame) -> DataFrame:
    """Relevant units of questions aligned with ``source(source_row, question)``; ``evidence(source_row, unit_url, evidence, ord)``.

    A question takes the source row at its place if the texts agree, else the only row with its text.
    """
    at = assemble.aligned(questions, source, "source_row", T.normalized(F.col("question")), T.normalized(F.col("question")))
    rows = at.select("query_id", F.col("matched_row").alias("source_row")).join(evidence, "source_row")
    unit = T.last_segment(F.col("unit_url"))
    return rows.groupBy("query_id", unit.alias("unit_id")).agg(F.lit(1).alias("relevance"), F.min_by("evidence", "ord").alias("evidence"), F.count(F.lit(1)).alias("evidence_count"))


def retrieve(questions: DataFrame, units: DataFrame, arm: str = "bm25", top_k: int = 4, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """A BM25 run in nested form, with its settings as columns."""
    top = ranking.bm25(questions, units, top_k, k1, b)
    return ranking.nested(questions, ranking.with_text(top, units), arm, bm25_k1=k1, bm25_b=b, top_k=top_k)


def write_run(run: DataFrame, path: str, n_questions: int, top_k: int = 4) -> None:
    """A run is written if it has a row for each question, no null, as many items as told, ``top_k`` at most, and no error."""
    checks.columns_present(run, ["query_id", "question", "golden_answer", "retrieved_items", "retrieved_count", "retrieval_error"])
    bad = {"blank_question": T.is_blank(F.col("question")), "null_answer": F.col("golden_answer").isNull(), "too_many_items": F.size("retrieved_items") > top_k, "count_differs": F.size("retrieved_items") != F.col("retrieved_count"), "error": F.coalesce("retrieval_error", F.lit("")) != ""}
    sinks.write_checked(run, path, bad, n_questions, "query_id")


def _searched(questions: DataFrame, search: Callable[[str], answers.Reply], arm: str, limit: int, settings: dict) -> DataFrame:
    """``questions`` with the service's best ``limit`` hits, ranked by their place, and what was asked for as columns."""
    asked = {"limit": limit, **settings}
    request = F.to_json(F.struct(F.col("question").alias("query"), F.col("allowed_doc_ids"), *[F.lit(v).alias(k) for k, v in asked.items()]))
    got = answers.called(questions.withColumn("prompt", request), search)
    hits = F.slice(F.coalesce(F.from_json("reply", f"array<{tables.HIT}>"), F.array().cast(f"array<{tables.HIT}>")), 1, limit)
    made = lambda x: F.coalesce(F.nullif(x["unit_id"], F.lit("")), T.compound_id(x["doc_id"], x["paragraph_idx"], x["subparagraph_idx"]))
    out = got.withColumn("hits", F.transform(hits, lambda x, i: x.withField("rank", (i + 1).cast("int")).withField("unit_id", made(x))))
    out = out.withColumns({"arm": F.lit(arm), "top_k": F.lit(limit), **{k: F.lit(v) for k, v in settings.items()}}).withColumnRenamed("reply_error", "retrieval_error")
    return out.drop("prompt", "reply", "input_tokens", "output_tokens", "total_tokens", "response_id", "response_model", "response_provider", "finish_reason")


def retrieve_external(questions: DataFrame, search: Callable[[str], answers.Reply], arm: str, limit: int = 4, **settings) -> DataFrame:
    """Rankings of an external service: ``search`` takes a JSON request (query, allowed ids, limit and the settings, such as level, weight
    and cutoff) and gives a JSON array of hits. Failures of single questions become their retrieval_error.
    """
    out = _searched(questions, search, arm, limit, settings)
    fields = ("rank", "unit_id", "doc_id", "text", "score")
    out = out.withColumn("retrieved_items", F.transform("hits", lambda x: F.struct(*[x[f].alias(f) for f in fields])))
    return out.withColumn("retrieved_count", F.size("hits").cast("long")).drop("hits")


def retrieve_windows(questions: DataFrame, search: Callable[[str], answers.Reply], arm: str, limit: int = 4, context: int = 2, **settings) -> DataFrame:
    """As ``retrieve_external`` for hits with their neighbours: windows in the order of their ranks, each sentence in the first that has it."""
    out = _searched(questions, search, arm, limit, {"context": context, **settings})
    top = windows.of_hits(out.select("query_id", F.explode("hits").alias("h")).select("query_id", "h.rank", "h.doc_id", "h.unit_id", "h.score", "h.text", "h.context"))
    items = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id", "doc_id", "text", "score"))).alias("retrieved_items"))
    out = out.drop("hits").join(items, "query_id", "left").withColumn("retrieved_items", F.coalesce("retrieved_items", F.array().cast(f"array<{tables.EXCERPT}>")))
    return out.withColumn("retrieved_count", F.size("retrieved_items").cast("long")).withColumn("retrieved_context", ranking.context())


def retrieve_searched(questions: DataFrame, hits: DataFrame, arm: str, limit: int = 4, **settings) -> DataFrame:
    """Rankings of ``hits`` as ``remote.search_hits`` has them, one row a question: settings, items, and the error of a question that failed."""
    item = F.struct("rank", "unit_id", "doc_id", "text", "score", "paragraph_idx", "subparagraph_idx")
    by = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("retrieval_error") == "", item))).alias("retrieved_items"), F.max("retrieval_error").alias("retrieval_error"))
    out = questions.join(by, "query_id", "left").withColumns({"arm": F.lit(arm), "top_k": F.lit(limit), **{k: F.lit(v) for k, v in settings.items()}})
    out = out.withColumn("retrieved_items", F.coalesce("retrieved_items", F.array().cast(by.schema["retrieved_items"].dataType))).withColumn("retrieval_error", F.coalesce("retrieval_error", F.lit("")))
    return out.withColumn("retrieved_count", F.size("retrieved_items").cast("long")).withColumn("retrieved_context", ranking.context())


def import_neural(spark: SparkSession, path: str, members: dict[str, str], columns: dict[str, str], order: str, dataset: str = "dataset") -> DataFrame:
    """Long retrieval rows of an archive: ``columns`` maps an arm to the column with its excerpts.

    Rows are numbered within their dataset by the column ``order``, never by their place in a file.
    """
    df = assemble.ordinals(archives.archive(spark, path, members), dataset, order)
    checks.require(checks.conditions(df, **{f"null_{c}": F.col(c).isNull() for c in (dataset, "question", "golden_answer")}))
    df = df.withColumn("query_id", T.padded_id(F.col(dataset), F.col("source_row")))
    return assemble.stacked(*[ranking.import_ranked(df, c, arm).drop(*columns.values()) for arm, c in columns.items()])


def handoff(questions: DataFrame, documents: DataFrame, arms: list[DataFrame], qrels: DataFrame, keep: Callable[[DataFrame], DataFrame] = scratch.kept) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All arms together with containment flags; the containment curve; recall and hit rates. ``keep`` writes what the full documents hold, which flags and curve read."""
    rows = assemble.stacked(*arms)
    flagged = metrics.containment(rows)
    flagged = flagged.join(metrics.relaxed(rows), ["query_id", "arm"], "left")
    full = keep(metrics.full_document(questions, documents, keep=keep))
    items = rows.select("query_id", "arm", F.explode("retrieved_items").alias("i")).select("query_id", "arm", "i.rank", "i.unit_id")
    return flagged.join(full, "query_id", "left"), metrics.curve(flagged, full), metrics.recall_hit(items, qrels)


def handoff_summary(flags: DataFrame, rates: DataFrame | None = None, top_k: int = 4) -> DataFrame:
    """One row an arm of a handoff's flags: questions, errors of the retrieval, the share of each flag and of the full documents, and with ``rates`` recall and hit at each k."""
    out = metrics.presence_means(flags, "arm", top_k=top_k)
    if rates is None:
        return out
    at = lambda name, k: F.max(F.when(F.col("k") == k, F.col(name))).alias(f"{name}_{k}")
    return out.join(rates.groupBy("arm").agg(*[at(name, k) for name in ("recall", "hit") for k in range(1, top_k + 1)]), "arm", "left")


def window_inputs(questions: DataFrame, anchors: DataFrame, sentences: DataFrame, radius: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contexts in rank order and in source order of the same sentences, and an audit of both."""
    allowed = questions if "allowed_doc_ids" in questions.columns else None
    bad = windows.anchor_faults(anchors, sentences, questions=allowed)
    checks.require(bad.agg(F.lit("anchors").alias("check"), F.count(F.lit(1)).alias("n_violations")))
    w = windows.expand(anchors, sentences, radius)
    by_rank = windows.rendered(w, by_rank=True).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "window_text"))), lambda x: x["window_text"]), "\n\n").alias("ranked_context"))
    by_source = windows.rendered(w, by_rank=False).select("query_id", F.col("window_text").alias("source_context"), "n_sentences")
    both = by_rank.join(by_source, "query_id").join(windows.duplicates_dropped(w), "query_id")
    audit = both.agg(F.avg("n_sentences").alias("mean_sentences"), F.avg("n_dropped").alias("mean_dropped"), F.avg(F.char_length("source_context")).alias("mean_characters"), F.avg(F.size(T.tokens(F.col("source_context")))).alias("mean_tokens"), metrics.count_if(F.col("ranked_context").eqNullSafe(F.col("source_context"))).alias("n_identical"))
    keep = [c for c in questions.columns]
    return questions.join(by_rank, "query_id").select(*keep, F.col("ranked_context").alias("context")), questions.join(by_source, "query_id").select(*keep, F.col("source_context").alias("context")), audit


def generate(spark: SparkSession, work: DataFrame, adapter, model: str, prompt_version: str, checkpoint: str, batches: int = 4, template: str = answers.TEMPLATE, settings: answers.Settings = answers.Settings(), concurrency: int | None = None) -> DataFrame:
    """All answers, resumed from ``checkpoint``; raises while any row still fails."""
    keys = ["query_id", "arm", "model", "prompt_version", "content_sha256"]
    tagged = work.withColumn("model", F.lit(model)).withColumn("prompt_version", F.lit(prompt_version)).withColumn("content_sha256", T.sha256(F.concat_ws("\n", "question", "context")))
    out = answers.resumed(spark, tagged, lambda df: answers.generated(df, adapter, model, prompt_version, template, settings, concurrency), checkpoint, answers.GENERATION, keys, "generation_error", batches)
    checks.require(checks.conditions(out, generation_error=F.col("generation_error") != ""))
    return out


def followed(spark: SparkSession, folder: str, adapter, model: str, prompt_version: str, path: str, template: str = answers.TEMPLATE, settings: answers.Settings = answers.Settings(), concurrency: int | None = None, most: int = 8, wait_ms: int = 1000) -> StreamingQuery:
    """Answers to the questions that arrive in ``folder`` as Parquet, as a running query; failed calls come again by timers, at most ``most`` times.

    ``attempts.results(spark, path, answers.GENERATION)`` reads what is done. A call is made once an attempt; no task sleeps.
    """
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    step = lambda df: answers.generated(df, adapter, model, prompt_version, template, settings, concurrency, attempts=1)
    return attempts.retried(stream, step, path, ["query_id", "arm"], "generation_error", most, wait_ms)


def judge(work: DataFrame, generations: DataFrame, adapter, model: str, mode: str = "binary", lenient: bool = False, failed_as_one: bool = False, checkpoint: str | None = None, batches: int = 4) -> tuple[DataFrame, DataFrame]:
    """Judgments of generations and their summary by arm; with a ``checkpoint`` only rows without a sound judgment are sent."""
    rows = work.select("query_id", "arm", "question", "golden_answer").join(generations.select("query_id", "arm", "generated_answer", "generation_error", "generation_sha256"), ["query_id", "arm"])
    if checkpoint:
        keys = ["query_id", "arm", "judge_model", "judge_mode", "generation_sha256"]
        tagged = rows.withColumn("judge_model", F.lit(model)).withColumn("judge_mode", F.lit(mode))
        out = answers.resumed(work.sparkSession, tagged, lambda df: answers.judged(df, adapter, model, mode, lenient), checkpoint, answers.JUDGMENT, keys, "judge_error", batches)
    else:
        out = answers.judged(rows, adapter, model, mode, lenient)
    out = metrics.failures_as_one(out) if failed_as_one else out
    return out, metrics.judge_summary(out, "arm")


def prompt_pilot(work: DataFrame, writers: dict[str, Callable], judges: dict[str, Callable], prompts: dict[str, str], judge_prompts: dict[str, str], selecting: str, template: str = answers.TEMPLATE, concurrency: int | None = None, keep: Callable[[DataFrame], DataFrame] = scratch.kept) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Which system prompt writes the best answers: (generations, judgments, cells, winner) over the rows of a cohort.

    ``work(query_id, arm, question, context, golden_answer)``; ``prompts`` and ``judge_prompts`` map a version to its system prompt. Every
    writer answers every row with every prompt, every judge judges every answer true or false with each of its prompts, and a cell is one
    writer, prompt, judge and judge's prompt with its accuracy and the label accuracy of its answers. The winner has the highest mean accuracy over the
    cells of the judge's prompt ``selecting``; ties go to fewer UTF-8 bytes, then the version. ``keep`` writes answers before they are judged.
    """
    if selecting not in judge_prompts or not (writers and judges and prompts):
        raise ValueError("a pilot needs a writer, a judge, a prompt and the selecting judge's prompt")
    checks.require(checks.unique(work, ["query_id", "arm"]))
    made, judged = [], []
    for model, adapter in writers.items():
        for version, system in prompts.items():
            out = keep(answers.generated(work, adapter, model, version, template, answers.Settings(system), concurrency))
            made.append(answers.labelled(out.join(work.select("query_id", "arm", "question", "golden_answer"), ["query_id", "arm"])).withColumn("prompt_sha256", T.sha256(F.lit(system))))
            for judge_model, judge_adapter in judges.items():
                for judge_version, judge_system in judge_prompts.items():
                    rows = answers.judged_boolean(made[-1], judge_adapter, judge_model, answers.Settings(judge_system, 256), concurrency)
                    judged.append(rows.select("*", F.lit(model).alias("model"), F.lit(version).alias("prompt_version"), F.lit(judge_version).alias("judge_prompt_version"), T.sha256(F.lit(judge_system)).alias("judge_prompt_sha256")))
    made, judged = assemble.stacked(*made), keep(assemble.stacked(*judged))
    right = judged.groupBy("model", "prompt_version", "judge_model", "judge_prompt_version").agg(F.count(F.lit(1)).alias("n_rows"), metrics.count_if(F.col("judge_error") != "").alias("n_errors"), F.avg(F.col("judge_correct").cast("int")).alias("accuracy"))
    cells = right.join(metrics.label_summary(made, "model", "prompt_version").select("model", "prompt_version", "parse_rate", "label_accuracy"), ["model", "prompt_version"])
    texts = work.sparkSession.createDataFrame(list(prompts.items()), "prompt_name string, prompt string")
    selected = cells.where(F.col("judge_prompt_version") == selecting).select(F.col("prompt_version").alias("prompt_name"), "accuracy").join(texts, "prompt_name")
    return made, judged, cells, sampling.prompt_winner(selected)


def paired_summary(long: DataFrame, a: str, b: str, value: str, binary: bool, *keys: str, whole: bool = False) -> DataFrame:
    """Means of two arms with contingency, or with score changes, histograms and transitions; ``whole`` demands the same questions in both."""
    if whole:
        paired.require_whole(long, a, b, *keys)
    pairs = paired.paired(long, a, b, value, *keys)
    parts = [paired.contingency(pairs, *keys)] if binary else [paired.deltas(pairs, *keys), paired.histograms(pairs, *keys), paired.transitions(pairs, *keys)]
    out = paired.means(pairs, *keys)
    for part in parts:
        out = out.join(part, list(keys)) if keys else out.crossJoin(F.broadcast(part))  # one row each
    return out


def wide_result(base: DataFrame, generations: DataFrame, judgments: DataFrame, models: list[str], judges: list[str]) -> DataFrame:
    """Base columns with generation_<model>__<field> and judgment_<judge>__<field>."""
    g = generations.withColumn("cell", F.concat(F.lit("generation_"), T.column_slug(F.col("model"))))
    j = judgments.withColumn("cell", F.concat(F.lit("judgment_"), T.column_slug(F.col("judge_model"))))
    out = assemble.widened(base, g, "cell", [f"generation_{m}" for m in models], ["generated_answer", "generation_error"])
    return assemble.widened(out, j, "cell", [f"judgment_{m}" for m in judges], ["verdict", "score", "reason"])


def published_metrics(summary: DataFrame, arms: list[str], metric_names: tuple[str, ...] = ("accuracy", "mean_score")) -> DataFrame:
    """One row per generator, judge and metric, arms as columns, cells that lack null."""
    keys = [c for c in ("generator", "judge") if c in summary.columns]
    return assemble.stacked(*[metrics.combined(summary, arms, m, *keys).withColumn("metric", F.lit(m)) for m in metric_names])


def validated(results: DataFrame, questions: DataFrame, units: DataFrame, judgments: DataFrame | None = None) -> DataFrame:
    """The report of all checks that apply."""
    arms = [r[0] for r in results.select("arm").distinct().orderBy("arm").collect()]  # a row an arm
    parts = [checks.unique(results, ["query_id", "arm"]), checks.coverage(results, questions, arms), checks.doc_filter(results, questions, units), checks.monotone(metrics.containment(results))]
    return checks.together(*parts, *([checks.judgments(judgments)] if judgments is not None else []))


def manifest(spark: SparkSession, root: str, listed: DataFrame | None = None) -> DataFrame:
    """The files under ``root``; or, against a listing, what differs."""
    found = tables.files(spark, root)
    return found if listed is None else sinks.manifest_differences(spark, listed, found)


def run_matrix(cells: dict[str, Callable[[], object]], width: int = 4) -> dict[str, object]:
    """Many (dataset, arm, model) cells side by side; all settle before any failure is raised."""
    return answers.settled(cells, width)


def paired_matrix(spark: SparkSession, work: DataFrame, arms: tuple[str, str], writers: dict[str, Callable], judges: dict[str, tuple[Callable, str]], prompt_version: str, root: str, width: int = 4, template: str = answers.TEMPLATE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both arms of ``work`` with all writers, all their answers with all judges: generations, judgments, paired summaries.

    ``writers`` maps a model to its adapter, ``judges`` to an adapter and a mode. First the rows are checked: both arms have
    the same questions, each once. Stages settle side by side, each resumes from its own checkpoint under ``root``,
    and judging starts when all answers are there. At the end the whole matrix is checked.
    """
    checks.require(checks.unique(work, ["query_id", "arm"]))
    paired.require_whole(work, *arms)
    made = run_matrix({m: lambda m=m, f=f: generate(spark, work, f, m, prompt_version, f"{root}/generations/{_slug(m)}", template=template) for m, f in writers.items()}, width)

    def cell(m: str, j: str) -> DataFrame:
        out, _ = judge(work, made[m], judges[j][0], j, judges[j][1], checkpoint=f"{root}/judgments/{_slug(m)}--{_slug(j)}")
        checks.require(checks.conditions(out, judge_error=F.col("judge_error") != ""))
        return out.withColumn("generator", F.lit(m))

    judged = run_matrix({f"{m} {j}": lambda m=m, j=j: cell(m, j) for m in writers for j in judges}, width)
    if not judged:
        raise ValueError("a matrix needs a writer and a judge at least")
    summaries = [_cell_summary(judged[f"{m} {j}"], arms, m, j, mode) for m in writers for j, (_, mode) in judges.items()]
    made, judged = assemble.stacked(*made.values()), assemble.stacked(*judged.values())
    checks.require(checks.matrix(work, made, judged, list(writers), list(judges), prompt_version))
    return made, judged, assemble.stacked(*summaries)


def _cell_summary(rows: DataFrame, arms: tuple[str, str], generator: str, judge_model: str, mode: str) -> DataFrame:
    rows = rows.withColumn("right", F.col("verdict") == "CORRECT")
    one = paired_summary(rows, *arms, "right" if mode == "binary" else "score", mode == "binary", whole=True)
    return one.withColumns({"generator": F.lit(generator), "judge": F.lit(judge_model), "judge_mode": F.lit(mode)})


def dual_label_matrix(spark: SparkSession, work: DataFrame, arms: tuple[str, str], writers: dict, judges: dict, root: str, prompt_version: str = "dual-label", labels: tuple[str, str] = ("True/Entailment", "False/Contradiction"), width: int = 4) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The paired matrix with a prompt that asks for one of two labels before the answer, and a summary of each writer's answers.

    What a parse of the label would give is no part of it: answers are measured by the judges alone.
    """
    asked = answers.TEMPLATE.replace("\n\n", f" Answer {labels[0]} or {labels[1]}, followed by a brief explanation.\n\n", 1)
    made, judged, paired_rows = paired_matrix(spark, work, arms, writers, judges, prompt_version, root, width, asked)
    return made, judged, paired_rows, metrics.generation_summary(made, "model", "prompt_version", "arm")


def extra_judge(spark: SparkSession, work: DataFrame, made: DataFrame, arms: tuple[str, str], adapter, model: str, mode: str, root: str, existing: DataFrame | None = None, order: tuple[list[str], list[str]] = ((), ())) -> tuple[DataFrame, DataFrame]:
    """One more judge over all answers of a matrix: its judgments, and the paired summaries with its rows put in or replaced.

    ``order`` lists generators and judges as the summary has them, others last.
    """
    writers = sorted(r[0] for r in made.select("model").distinct().collect())  # a row a writer
    cells = run_matrix({m: lambda m=m: judge(work, made.where(F.col("model") == m), adapter, model, mode, checkpoint=f"{root}/judgments/{_slug(m)}--{_slug(model)}")[0] for m in writers})
    rows = {m: df.withColumn("generator", F.lit(m)) for m, df in cells.items()}
    new = assemble.stacked(*[_cell_summary(df, arms, m, model, mode) for m, df in rows.items()])
    summary = new if existing is None else assemble.upserted(existing, new, keys=["generator", "judge"])
    at = [F.when(F.col(c).isin(*names), F.array_position(F.array(*map(F.lit, names)), F.col(c))).otherwise(len(names) + 1) if names else F.lit(0) for c, names in zip(("generator", "judge"), order, strict=True)]
    return assemble.stacked(*rows.values()), summary.orderBy(*at, "generator", "judge")


def arm_matrix(spark: SparkSession, datasets: dict[str, tuple[DataFrame, DataFrame]], arm: str, writers: dict[str, Callable], judges: dict[str, tuple[Callable, str]], prompt_version: str, root: str, width: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One more retrieval arm over many datasets with all writers and judges: generations, judgments, and a summary by dataset, generator and judge.

    ``datasets`` maps a name to (questions, retrieved(source_row, question, context)): the arm's rows must be the questions' in their order. Cells resume
    from checkpoints of their own; rows that failed are done again; all cells settle before a failure is raised.
    """
    works = {}
    for name, (questions, retrieved) in datasets.items():
        one = lambda df: df.withColumn("dataset", F.lit(name))  # noqa: E731, B023
        rows, faults = assemble.by_position(one(questions).drop("context"), one(retrieved), "dataset", "source_row", "source_row", ["question"])
        checks.require(faults.agg(F.lit(f"{name}: order").alias("check"), F.count(F.lit(1)).alias("n_violations")))
        works[name] = rows.withColumn("arm", F.lit(arm))
    made = run_matrix({f"{d} {m}": lambda d=d, m=m: generate(spark, works[d], writers[m], m, prompt_version, f"{root}/{d}/generations/{_slug(m)}") for d in works for m in writers}, width)
    cells = [(d, m, j) for d in works for m in writers for j in judges]
    judged = run_matrix({" ".join(c): lambda c=c: judge(works[c[0]], made[f"{c[0]} {c[1]}"], judges[c[2]][0], c[2], judges[c[2]][1], checkpoint=f"{root}/{c[0]}/judgments/{_slug(c[1])}--{_slug(c[2])}")[0] for c in cells}, width)
    named = lambda c: judged[" ".join(c)].withColumns({"dataset": F.lit(c[0]), "generator": F.lit(c[1]), "judge": F.lit(c[2])})
    rows = assemble.stacked(*[named(c) for c in cells])
    answered = assemble.stacked(*[made[f"{d} {m}"].withColumn("dataset", F.lit(d)) for d in works for m in writers])
    return answered, rows, metrics.judge_summary(rows, "dataset", "arm", "generator", "judge", "judge_mode")


def _slug(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9._-]+", "-", name).strip("-")


def development_rows(frame: DataFrame, method: str, size: int = 100, salt: str = "pilot") -> DataFrame:
    """The stable sample of a frozen run, after its preconditions: one method, unique ids, no errors, enough development rows."""
    checks.columns_present(frame, ["dataset", "query_id", "split", "source_row", "question", "golden_answer", "retrieval_method", "retrieved_context", "retrieval_error"])
    checks.require(checks.development(frame, method, size))
    return sampling.stable_sample(frame, size, salt)
