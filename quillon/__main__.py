"""python -m quillon COMMAND: the pipelines over Parquet tables.

    prepare QUERIES SOURCES ALLOWED DATASET OUT              questions from their parts
    units DOCUMENTS LEVEL OUT ID...                          retrieval units with compound ids
    qrels QUESTIONS SOURCE EVIDENCE OUT                      relevant units by position, else by text
    import ARCHIVE ORDER OUT --member NAME=KIND --column ARM=COLUMN   rankings of an archive
    bm25 QUESTIONS UNITS OUT [--top-k 4 --k1 1.2 --b 0.75]   a BM25 run
    score QUESTIONS DOCUMENTS QRELS OUT RUN...               flags, curve.{csv,json}, rates.{csv,json}
    windows QUESTIONS ANCHORS SENTENCES OUT                  contexts in rank and in source order, audit
    pilot RUN METHOD OUT [--size 100]                        the development rows of a frozen run
    prompt-pilot WORK OUT SELECTING --writer MODEL=ADAPTER --judge MODEL=ADAPTER --prompt VERSION=TEXT --judge-prompt VERSION=TEXT   system prompts against each other, and the one that wins
    generate WORK ADAPTER MODEL VERSION OUT [--system TEXT --concurrency N]   answers, resumed from OUT.checkpoint
    follow WORK ADAPTER MODEL VERSION OUT [--rows N --most 8]   answers to questions as their files arrive, until N are done or for ever
    judge WORK GENERATIONS ADAPTER MODEL OUT [--mode binary] judgments, resumed from OUT.checkpoint, and their summary
    matrix WORK ARM ARM VERSION OUT --writer MODEL=ADAPTER --judge MODEL=ADAPTER=MODE   both arms with all models
    dual-label WORK ARM ARM OUT --writer MODEL=ADAPTER --judge MODEL=ADAPTER=MODE   the matrix with a prompt that asks for a label first
    extra-judge WORK GENERATIONS ARM ARM MODEL ADAPTER OUT [--mode binary] [--existing PAIRED]   one more judge over a matrix
    wide BASE GENERATIONS JUDGMENTS OUT                      one row a question, a column a model and field
    metrics SUMMARY OUT ARM...                               published cells, arms as columns
    judge-summary JUDGMENTS OUT KEY...                       summary.{csv,json}
    paired LONG A B VALUE OUT [--scores]                     paired.{csv,json}
    check RUN QUESTIONS UNITS                                the checks; exit 1 if one fails
    manifest ROOT [LISTING]                                  a listing, or what differs from it

With --dataset NAME all tables that have a column dataset are cut down to it.
An adapter is MODULE:FUNCTION, a function from a prompt to a Reply, or stub_writer or stub_judge.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from quillon.functions import text as T
from quillon.operators import columns, metrics
from quillon.plans import answers, pipelines
from quillon.sources import sinks
from quillon.streaming import attempts

COMMANDS = [line.split()[0] for line in __doc__.splitlines() if line.startswith("    ")]


def adapter(name: str):
    module, _, function = name.rpartition(":")
    return getattr(importlib.import_module(module) if module else answers, function)


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="quillon", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--top-k", type=int, default=4)
    parser.add_argument("--k1", type=float, default=1.2)
    parser.add_argument("--b", type=float, default=0.75)
    parser.add_argument("--scores", action="store_true")
    parser.add_argument("--size", type=int, default=100)
    parser.add_argument("--mode", default="binary")
    parser.add_argument("--concurrency", type=int)
    parser.add_argument("--system", default="")
    parser.add_argument("--rows", type=int)
    parser.add_argument("--seconds", type=float, default=3600)
    parser.add_argument("--most", type=int, default=8)
    parser.add_argument("--dataset")
    parser.add_argument("--existing")
    for name in ("member", "column", "writer", "judge", "prompt", "judge-prompt"):
        parser.add_argument(f"--{name}", action="append", default=[])
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    p, put = a.paths, sinks.write_table

    def read(path: str):
        df = spark.read.parquet(path)
        return columns.of_dataset(df, a.dataset) if a.dataset and "dataset" in df.columns else df

    split = lambda items, n: [x.split("=", n) for x in items]
    match a.command:
        case "prepare":
            put(pipelines.prepare_questions(read(p[0]), read(p[1]), read(p[2]), p[3]), p[4])
        case "units":
            put(pipelines.prepare_units(read(p[0]), p[1], p[3:]), p[2])
        case "qrels":
            put(pipelines.positional_qrels(read(p[0]), read(p[1]), read(p[2])), p[3])
        case "import":
            put(pipelines.import_neural(spark, p[0], dict(split(a.member, 1)), dict(split(a.column, 1)), p[1]), p[2])
        case "bm25":
            questions = read(p[0])
            pipelines.write_run(pipelines.retrieve(questions, read(p[1]), top_k=a.top_k, k1=a.k1, b=a.b), p[2], questions.count(), a.top_k)
        case "score":
            flags, curve, rates = pipelines.handoff(read(p[0]), read(p[1]), [read(x) for x in p[4:]], read(p[2]))
            put(flags, f"{p[3]}/flags")
            sinks.write_summary(curve, f"{p[3]}/curve")
            sinks.write_summary(rates, f"{p[3]}/rates")
            sinks.write_summary(pipelines.handoff_summary(flags, rates), f"{p[3]}/summary")
        case "windows":
            ranked, source, audit = pipelines.window_inputs(read(p[0]), read(p[1]), read(p[2]))
            put(ranked, f"{p[3]}/ranked")
            put(source, f"{p[3]}/source")
            sinks.write_summary(audit, f"{p[3]}/audit")
        case "pilot":
            put(pipelines.development_rows(read(p[0]), p[1], a.size), p[2])
        case "prompt-pilot":
            named = lambda items: {m: adapter(f) for m, f in split(items, 1)}
            made, judged, cells, winner = pipelines.prompt_pilot(read(p[0]), named(a.writer), named(a.judge), dict(split(a.prompt, 1)), dict(split(a.judge_prompt, 1)), p[2], concurrency=a.concurrency)
            put(made, f"{p[1]}/generations")
            put(judged, f"{p[1]}/judgments")
            sinks.write_summary(cells, f"{p[1]}/cells")
            sinks.write_summary(winner, f"{p[1]}/selected-prompt")
        case "generate":
            put(pipelines.generate(spark, read(p[0]), adapter(p[1]), p[2], p[3], f"{p[4]}.checkpoint", settings=answers.Settings(a.system), concurrency=a.concurrency), p[4])
        case "follow":
            query = pipelines.followed(spark, p[0], adapter(p[1]), p[2], p[3], f"{p[4]}.attempts", settings=answers.Settings(a.system), concurrency=a.concurrency, most=a.most)
            if a.rows is None:
                query.awaitTermination()
            put(attempts.settled(query, spark, f"{p[4]}.attempts", answers.GENERATION, a.rows, a.seconds), p[4])
        case "judge":
            rows, summary = pipelines.judge(read(p[0]), read(p[1]), adapter(p[2]), p[3], a.mode, checkpoint=f"{p[4]}.checkpoint")
            put(rows, p[4])
            sinks.write_summary(summary, f"{p[4]}-summary")
        case "matrix":
            writers = {m: adapter(f) for m, f in split(a.writer, 1)}
            judges = {m: (adapter(f), mode) for m, f, mode in split(a.judge, 2)}
            made, judged, paired = pipelines.paired_matrix(spark, read(p[0]), (p[1], p[2]), writers, judges, p[3], f"{p[4]}/checkpoints")
            put(made, f"{p[4]}/generations")
            put(judged, f"{p[4]}/judgments")
            sinks.write_summary(paired, f"{p[4]}/paired")
            sinks.write_provenance(f"{p[4]}/provenance.json", {"work": p[0], "arms": p[1:3], "prompt_version": p[3], "writers": a.writer, "judges": a.judge})
        case "dual-label":
            writers = {m: adapter(f) for m, f in split(a.writer, 1)}
            judges = {m: (adapter(f), mode) for m, f, mode in split(a.judge, 2)}
            made, judged, paired, summary = pipelines.dual_label_matrix(spark, read(p[0]), (p[1], p[2]), writers, judges, f"{p[3]}/checkpoints")
            put(made, f"{p[3]}/generations")
            put(judged, f"{p[3]}/judgments")
            sinks.write_summary(paired, f"{p[3]}/paired")
            sinks.write_summary(summary, f"{p[3]}/generations-summary")
        case "extra-judge":
            judged, paired = pipelines.extra_judge(spark, read(p[0]), read(p[1]), (p[2], p[3]), adapter(p[5]), p[4], a.mode, f"{p[6]}/checkpoints", read(a.existing) if a.existing else None)
            put(judged, f"{p[6]}/judgments")
            put(paired, f"{p[6]}/paired-rows")
            sinks.write_summary(paired, f"{p[6]}/paired")
        case "wide":
            g, j = read(p[1]), read(p[2])
            names = lambda df, c: sorted(r[0] for r in df.select(T.column_slug(df[c])).distinct().collect())  # noqa: E731  a row a model
            put(pipelines.wide_result(read(p[0]), g, j, names(g, "model"), names(j, "judge_model")), p[3])
        case "metrics":
            sinks.write_summary(pipelines.published_metrics(read(p[0]), p[2:]), p[1])
        case "judge-summary":
            sinks.write_summary(metrics.judge_summary(read(p[0]), *p[2:]), p[1])
        case "paired":
            sinks.write_summary(pipelines.paired_summary(read(p[0]), p[1], p[2], p[3], binary=not a.scores), p[4])
        case "check":
            report = pipelines.validated(read(p[0]), read(p[1]), read(p[2]))
            sinks.show(report)
            return int(report.where("n_violations > 0").count() > 0)
        case "manifest":
            sinks.show(pipelines.manifest(spark, p[0], read(p[1]) if len(p) > 1 else None), 1000)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
