"""Messages, settings, filters, bounded concurrency and the prompt pilot."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.plans import answers, pipelines

WORK = "query_id string, arm string, question string, context string, golden_answer string"


@pytest.fixture(scope="module")
def work(spark):
    return spark.createDataFrame([(f"q{i}", "bm25", f"question {i}", "alpha beta", "Entailment" if i % 2 else "Contradiction") for i in range(12)], WORK)


def test_what_may_follow_a_label(spark):
    ends = [" ", "\n", ":", ".", ",", ";", "!", "?", ")", "]", "}", "'", '"', "-", "—", "", " "]
    rows = [(f"{head}entailMENT{e}{tail}", True) for e in ends for head in ("", " \n") for tail in (("",) if e == "" else ("", "yes"))] + [(f"Entailment{e}", False) for e in ("s", "/", "–", "_", "*")] + [("True/Entailment", False), ("", False), (None, False)]
    got = spark.createDataFrame(rows, "x string, ok boolean").select("x", "ok", T.leading_label(F.col("x"), ("Entailment", "Contradiction")).alias("label")).collect()
    assert [r for r in got if r.label != ("Entailment" if r.ok else None)] == []


def test_messages_and_settings_reach_the_adapter(spark, work):
    def adapter(request):
        return answers.Reply(json.dumps([request.messages(), request.settings.max_tokens, request.settings.effort, request.settings.response_schema]), 3, 4)

    settings = answers.Settings("be brief", 99, "low", '{"type": "object"}')
    row = answers.generated(work.limit(1), adapter, "m", "v", "{question}?", settings).first()
    assert json.loads(row.generated_answer) == [[{"role": "system", "content": "be brief"}, {"role": "user", "content": "question 0?"}], 99, "low", '{"type": "object"}']
    assert answers.Request("p", answers.Settings()).messages() == [{"role": "user", "content": "p"}]


def test_only_an_empty_context_is_refused(spark, work):
    rows = work.limit(3).withColumn("context", F.expr("CASE query_id WHEN 'q0' THEN '' WHEN 'q1' THEN ' \n' END"))
    got = {r.query_id: r.generated_answer for r in answers.generated(rows, lambda p: answers.Reply("sent"), "m", "v").collect()}
    assert got == {"q0": answers.REFUSAL, "q1": "sent", "q2": answers.REFUSAL}


@pytest.mark.parametrize("mode", ["binary", "scale-1-5"])
def test_a_filtered_judgment_keeps_its_ids_and_tokens(spark, work, mode):
    made = work.select("*", F.lit("answer").alias("generated_answer"), F.lit("").alias("generation_error"), F.lit("h").alias("generation_sha256")).limit(2)

    def judge(prompt):
        if "question 0" in prompt:
            return answers.Reply("", 7, 1, None, "id-7", "judge-x", "host", answers.FILTER)
        return answers.Reply('{"verdict": "CORRECT", "reason": "r"}' if mode == "binary" else '{"score": 4, "reason": "r"}', 5, 5, None, "id-8", finish_reason=answers.FILTER)

    got = {r.query_id: r for r in answers.judged(made, judge, "j", mode).collect()}
    f, ok = got["q0"], got["q1"]
    assert (f.verdict, f.score, f.reason, f.judge_error, f.judge_fallback) == ("INCORRECT" if mode == "binary" else "", None, answers.FILTERED_REASON, "", answers.FILTERED)
    assert (f.judge_response_id, f.judge_input_tokens, f.judge_output_tokens, f.judge_total_tokens, f.judge_response_model, f.judge_response_provider) == ("id-7", 7, 1, 8, "judge-x", "host")
    assert (ok.verdict, ok.score, ok.judge_fallback, ok.reason) == (("CORRECT", None, "", "r") if mode == "binary" else ("", 4, "", "r"))  # a sound reply stands


@pytest.mark.parametrize("most", [1, 3, 16])
def test_calls_at_one_time_are_bounded(spark, tmp_path, most):
    """However many partitions the rows have, no more than ``most`` calls overlap."""

    def adapter(prompt):
        began = time.time()
        time.sleep(0.05)
        (tmp_path / f"{most}-{prompt}").write_text(f"{began} {time.time()}")
        return answers.Reply("ok")

    rows = spark.range(64).repartition(16).select(F.col("id").cast("string").alias("prompt"))
    assert answers.called(rows, adapter, concurrency=most).where("reply = 'ok'").count() == 64
    spans = [tuple(map(float, f.read_text().split())) for f in tmp_path.glob(f"{most}-*")]
    assert len(spans) == 64 and max(sum(a <= began < b for a, b in spans) for began, _ in spans) <= most


def test_the_prompt_that_writes_better_answers_wins(spark, work):
    """Two system prompts give two different sets of requests, and the judged text of the answers decides, not the version's name."""

    def writer(request):
        labels = {"say the gold label": "Entailment" if int(request.split()[-1]) % 2 else "Contradiction", "say nothing of use": "Neither"}
        return answers.Reply(labels[request.settings.system] + ": because")

    def judge(request):
        gold, answer = (request.split(f"{key}: ", 1)[1].split("\n")[0] for key in ("Reference", "Answer"))
        return answers.Reply(json.dumps({"correct": answer.startswith(gold) if request.settings.system == "strictly" else True}))

    prompts = {"a-worse": "say nothing of use", "z-better": "say the gold label"}
    made, judged, cells, winner = pipelines.prompt_pilot(work, {"m": writer, "n": writer}, {"j": judge}, prompts, {"clear": "strictly", "loose": "kindly"}, "clear", "{context} {question}")
    assert made.count() == 48 and judged.count() == 96 and made.select("prompt_sha256").distinct().count() == 2
    got = {(r.model, r.prompt_version, r.judge_prompt_version): (r.n_rows, r.n_errors, r.accuracy, r.label_accuracy) for r in cells.collect()}
    assert got == {(m, p, j): (12, 0, 1.0 if p == "z-better" or j == "loose" else 0.0, 1.0 if p == "z-better" else 0.0) for m in "mn" for p in prompts for j in ("clear", "loose")}
    w = winner.collect()
    assert len(w) == 1 and (w[0].prompt_name, w[0].prompt, w[0].mean_accuracy, w[0].n_cells) == ("z-better", "say the gold label", 1.0, 2)
    with pytest.raises(ValueError):
        pipelines.prompt_pilot(work, {"m": writer}, {"j": judge}, prompts, {"clear": "strictly"}, "none")
