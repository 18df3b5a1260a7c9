"""Generation and judging of answers behind adapters, in resumable batches.

An adapter is a function from a prompt to a reply; it runs inside ``mapInPandas``, so calls go out from all
executors. Offline stubs are deterministic. A row's failure becomes its error column, never the
job's; a blank context is answered without a call.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import assemble
from quillon.sources import scratch, sinks

# fixed values
REFUSAL = "Cannot be determined from the supplied context."
FAILED = "Answer generation failed."
FILTERED = "content_filter_score_excluded"
FILTERED_REASON = "Judge returned no result because of content filtering; excluded from the 1--5 mean by evaluation policy."
FILTER = "content_filter"
NO_REASON = "No reason returned."
#: What a writer is asked; other wordings are other prompt versions.
TEMPLATE = "Answer from the context alone.\n\nContext:\n{context}\n\nQuestion: {question}"
#: How often a judge is asked for an object of the right form.
ASKS = 4
GENERATION = "query_id string, arm string, model string, prompt_version string, content_sha256 string, generated_answer string, generation_error string, input_tokens long, output_tokens long, generation_sha256 string, response_id string, total_tokens long, response_model string, response_provider string, retrieval_context_sha256 string"
JUDGMENT = "query_id string, arm string, judge_model string, judge_mode string, generation_sha256 string, verdict string, score int, reason string, judge_error string, judge_fallback string, judge_total_tokens long, judge_response_id string, judge_input_tokens long, judge_output_tokens long, judge_response_model string, judge_response_provider string"


class Transient(RuntimeError):
    """A failure that another call may not have: rate limits, connections, server errors."""


class Refused(RuntimeError):
    """The judge's content filter refused the row."""


@dataclass(frozen=True)
class Reply:
    text: str | list
    input_tokens: int = 0
    output_tokens: int = 0
    total_tokens: int | None = None
    response_id: str = ""
    model: str = ""
    provider: str = ""
    finish_reason: str = ""


@dataclass(frozen=True)
class Settings:
    """What goes with every prompt of a run: the system message, limits, and the JSON schema of a reply (as JSON, empty for free text)."""

    system: str = ""
    max_tokens: int = 2048
    effort: str = "none"
    response_schema: str = ""


class Request(str):
    """A user prompt with the settings of its run: an adapter that needs no settings takes it for the text it is."""

    settings: Settings

    def __new__(cls, prompt: str, settings: Settings):
        request = super().__new__(cls, prompt)
        request.settings = settings
        return request

    def messages(self) -> list[dict[str, str]]:
        """The messages of a chat completion."""
        system = [{"role": "system", "content": self.settings.system}] if self.settings.system else []
        return [*system, {"role": "user", "content": str(self)}]


def retried(call: Callable[[], Reply], attempts: int = 8, base: float = 1.0, cap: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Reply:
    """``call`` again after transient failures, waiting twice as long each time, with jitter, up to ``cap`` seconds."""
    for i in range(attempts):
        try:
            return call()
        except Transient:
            if i == attempts - 1:
                raise
            sleep(min(cap, base * 2**i) * (0.5 + random.random() / 2))
    raise AssertionError("unreachable")


def reply_text(content: str | list) -> str:
    """The text of a completion, be it a string or a list of parts, without white space around it."""
    return (content if isinstance(content, str) else "".join(p if isinstance(p, str) else p.get("text", "") for p in content or [])).strip()


def stub_writer(prompt: str) -> Reply:
    """Echoes the first words of the context: a pure function of the prompt."""
    body = prompt.split("Context:\n", 1)[-1].split("\n\nQuestion:", 1)[0]
    words = body.split()
    return Reply(" ".join(words[:12]), len(prompt.split()), min(12, len(words)))


def stub_judge(prompt: str) -> Reply:
    """A JSON judgment of the kind asked for by the prompt's hash, fenced as models like to."""
    n = int(hashlib.sha256(prompt.encode()).hexdigest()[:8], 16)
    first = f'"score": {n % 5 + 1}' if "score and reason" in prompt.split("\n", 1)[0] else f'"verdict": "{"CORRECT" if n % 2 else "INCORRECT"}"'
    return Reply(f'```json\n{{{first}, "reason": "stub"}}\n```', len(prompt.split()), 8)


def prompt(context: Column, question: Column, template: str = TEMPLATE) -> Column:
    """``template`` with {context} and {question} filled in; every other character stands for itself."""
    filled = {"{context}": context, "{question}": question}
    return F.concat(*[filled.get(part, F.lit(part)) for part in re.split(r"(\{context\}|\{question\})", template)])


def judge_prompt(question: Column, gold: Column, answer: Column, mode: str = "binary") -> Column:
    asked = {"binary": "verdict and reason", "boolean": "correct"}.get(mode, "score and reason")
    return F.concat(F.lit(f"Compare the answer with the reference. Reply with a JSON object of {asked}.\n\nQuestion: "), question, F.lit("\nReference: "), gold, F.lit("\nAnswer: "), answer)


def is_judgment(reply: str, mode: str, lenient: bool = False) -> bool:
    """Whether a reply holds an object of the mode: its keys and no others, values in their domain."""
    found = re.search(r"\{.*\}", reply or "", re.DOTALL)
    try:
        body = json.loads(found.group()) if found else None
    except ValueError:
        return False
    if not isinstance(body, dict):
        return False
    if mode == "boolean":
        return set(body) == {"correct"} and isinstance(body["correct"], bool)
    value = body.get("verdict" if mode == "binary" else "score")
    sound = value in ("CORRECT", "INCORRECT") if mode == "binary" else not isinstance(value, bool) and str(value) in ("1", "2", "3", "4", "5")
    return sound and (lenient or set(body) == {"verdict" if mode == "binary" else "score", "reason"} and isinstance(body["reason"], str))


#: Threads of one task that wait for replies.
THREADS = 8


def called(df: DataFrame, adapter: Callable[[Request], Reply], column: str = "prompt", attempts: int = 8, valid: Callable[[str], bool] | None = None, settings: Settings = Settings(), concurrency: int | None = None) -> DataFrame:
    """``df`` with what a Reply holds and reply_error; rows whose prompt is null aren't sent.

    A reply that isn't ``valid`` is asked for again, ASKS times in all; the last one is given as it is, and one that the
    content filter ended at once. ``concurrency`` bounds the calls at one time over the whole cluster: the rows are dealt to so many tasks that
    these with their threads make no more.
    """
    names = df.columns
    extra_kinds = "reply string, reply_error string, input_tokens long, output_tokens long, total_tokens long, response_id string, response_model string, response_provider string, finish_reason string"
    extra_names = [x.split()[0] for x in extra_kinds.split(", ")]
    threads = THREADS if concurrency is None else max(1, min(THREADS, concurrency))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(p: str | None) -> tuple:
            if p is None:
                return None, "", 0, 0, 0, "", "", "", ""
            request = Request(p, settings)
            try:
                got = retried(lambda: adapter(request), attempts)
                for i in range(ASKS - 1 if valid else 0):
                    if got.finish_reason == FILTER or valid(reply_text(got.text)):
                        break
                    time.sleep(0.25 * (i + 1))
                    got = retried(lambda: adapter(request), attempts)
                total = got.input_tokens + got.output_tokens if got.total_tokens is None else got.total_tokens
                return reply_text(got.text), "", got.input_tokens, got.output_tokens, total, got.response_id, got.model, got.provider, got.finish_reason
            except Exception as e:  # a row's failure is data
                return None, f"{type(e).__name__}: {e}"[:500], 0, 0, 0, "", "", "", ""

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(one, [None if pd.isna(p) else p for p in pdf[column]]))
                yield pd.concat([pdf[names], pd.DataFrame(got, columns=extra_names, index=pdf.index)], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    dealt = df if concurrency is None else df.repartition(max(1, concurrency // threads))
    return dealt.mapInPandas(run, f"{kinds}, {extra_kinds}")


def generated(work: DataFrame, adapter: Callable[[str], Reply], model: str, prompt_version: str, template: str = TEMPLATE, settings: Settings = Settings(), concurrency: int | None = None, attempts: int = 8) -> DataFrame:
    """Answers for ``work(query_id, arm, question, context)``, as GENERATION.

    An empty context is answered without a call; one of white space is sent. An empty reply is an error; errors are the name of the exception's type.
    """
    blank = F.coalesce("context", F.lit("")) == ""
    sent = work.select("query_id", "arm", T.sha256(F.concat_ws("\n", "question", "context")).alias("content_sha256"), T.sha256(F.col("context")).alias("retrieval_context_sha256"), F.when(~blank, prompt(F.col("context"), F.col("question"), template)).alias("prompt"))
    out = called(sent, adapter, attempts=attempts, settings=settings, concurrency=concurrency)
    answer = F.when(F.col("prompt").isNull(), F.lit(REFUSAL)).otherwise(T.stripped(F.coalesce("reply", F.lit(""))))
    error = F.when(F.col("reply_error") != "", F.substring_index("reply_error", ":", 1)).when(answer == "", "ValueError").otherwise("")
    return out.withColumn("answer", answer).withColumn("error", error).select(
        "query_id", "arm", F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), "content_sha256", F.col("answer").alias("generated_answer"), F.col("error").alias("generation_error"), "input_tokens", "output_tokens",
        T.sha256(F.concat_ws("\n", "answer", "error")).alias("generation_sha256"), "response_id", "total_tokens", "response_model", "response_provider", "retrieval_context_sha256",
    )


def judgment_fields(reply: Column, mode: str) -> dict[str, Column]:
    """verdict, score, reason and what is wrong with a reply: the object's keys are those of the mode and its values in their domain."""
    body = T.json_object(reply)
    verdict, score, reason = F.get_json_object(body, "$.verdict"), F.get_json_object(body, "$.score").try_cast("int"), F.get_json_object(body, "$.reason")
    closed = F.array_sort(F.json_object_keys(body)) == F.array(*map(F.lit, sorted(("verdict" if mode == "binary" else "score", "reason"))))
    sound = closed & reason.isNotNull() & (verdict.isin("CORRECT", "INCORRECT") if mode == "binary" else score.between(1, 5))
    return {
        "verdict": F.when(F.lit(mode == "binary") & sound, verdict).otherwise(F.lit("")),
        "score": F.when(F.lit(mode != "binary") & sound, score).cast("int"),
        "reason": F.coalesce(reason, F.lit("")),
        "wrong": F.when(body.isNull(), "no object").when(~F.coalesce(sound, F.lit(False)), "invalid object").otherwise(""),
    }


def repaired(reply: Column) -> Column:
    """A lenient reading of a score: its reason, or else the first other text there is, as an object again."""
    body = T.json_object(reply)
    others = F.map_filter(F.from_json(body, "map<string,string>"), lambda k, v: (k != "score") & v.try_cast("double").isNull())
    reason = F.coalesce(F.get_json_object(body, "$.reason"), F.get(F.map_values(others), F.lit(0)), F.lit(NO_REASON))
    return F.to_json(F.struct(F.get_json_object(body, "$.score").alias("score"), reason.alias("reason")))


def judged(work: DataFrame, adapter: Callable[[str], Reply], model: str, mode: str = "binary", lenient: bool = False, settings: Settings = Settings(max_tokens=256), concurrency: int | None = None) -> DataFrame:
    """Judgments of ``work(query_id, arm, question, golden_answer, generated_answer, generation_error, generation_sha256)``.

    A row whose generation failed isn't sent. A refusal gives no score and a fallback tag; both count as INCORRECT
    where the mode is binary. Replies of another form are asked for again. A refusal is a reply that the content filter ended, whose ids and
    tokens are kept, or a Refused that the adapter raises.
    """
    failed = F.coalesce("generation_error", F.lit("")) != ""
    sent = work.select("query_id", "arm", "generation_sha256", failed.alias("failed"), F.when(~failed, judge_prompt(F.col("question"), F.col("golden_answer"), F.col("generated_answer"), mode)).alias("prompt"))
    out = called(sent, adapter, valid=lambda reply: is_judgment(reply, mode, lenient), settings=settings, concurrency=concurrency)
    lenient = lenient and mode != "binary"
    x = judgment_fields(repaired(F.col("reply")) if lenient else F.col("reply"), mode)
    refused = F.col("reply_error").startswith("Refused") | ((F.col("finish_reason") == FILTER) & (F.coalesce(x["wrong"], F.lit("no object")) != ""))
    error = F.when(F.col("failed"), "generation_error").when(refused, "").when(F.col("reply_error") != "", F.col("reply_error")).otherwise(x["wrong"])
    wrong = F.lit("INCORRECT" if mode == "binary" else "")
    return out.select(
        "query_id", "arm", F.lit(model).alias("judge_model"), F.lit(mode).alias("judge_mode"), "generation_sha256", F.when(F.col("failed") | refused, wrong).otherwise(F.coalesce(x["verdict"], F.lit(""))).alias("verdict"), F.when(~refused, x["score"]).alias("score"),
        F.when(F.col("failed"), FAILED).when(refused, FILTERED_REASON).otherwise(F.coalesce(x["reason"], F.lit(""))).alias("reason"),
        F.coalesce(error, F.lit("no object")).alias("judge_error"), F.when(refused, FILTERED).otherwise("").alias("judge_fallback"), F.col("total_tokens").alias("judge_total_tokens"),
        F.col("response_id").alias("judge_response_id"), F.col("input_tokens").alias("judge_input_tokens"), F.col("output_tokens").alias("judge_output_tokens"), F.col("response_model").alias("judge_response_model"), F.col("response_provider").alias("judge_response_provider"),
    )


def judged_boolean(work: DataFrame, adapter: Callable[[str], Reply], model: str, settings: Settings = Settings(max_tokens=256), concurrency: int | None = None) -> DataFrame:
    """query_id, arm, judge_model, judge_correct (false where the judge failed), judge_error, judge_total_tokens of ``work(query_id, arm, question, golden_answer, generated_answer)``."""
    out = called(work.select("query_id", "arm", judge_prompt(F.col("question"), F.col("golden_answer"), F.col("generated_answer"), "boolean").alias("prompt")), adapter, settings=settings, concurrency=concurrency)
    body = T.json_object(F.col("reply"))
    right = F.get_json_object(body, "$.correct")
    sound = F.coalesce((F.json_object_keys(body) == F.array(F.lit("correct"))) & right.isin("true", "false"), F.lit(False))
    error = F.when(F.col("reply_error") != "", F.substring_index("reply_error", ":", 1)).when(sound, "").otherwise("ValueError")
    return out.select("query_id", "arm", F.lit(model).alias("judge_model"), (sound & (right == "true")).alias("judge_correct"), error.alias("judge_error"), F.col("total_tokens").alias("judge_total_tokens"))


def labelled(generations: DataFrame, labels: tuple[str, ...] = ("Entailment", "Contradiction")) -> DataFrame:
    """Label parse and correctness of generations that come with a golden_answer."""
    label = T.leading_label(F.col("generated_answer"), labels)
    return generations.withColumn("parsed_label", label).withColumn("label_correct", F.coalesce(label == F.col("golden_answer"), F.lit(False)))


def resumed(spark: SparkSession, work: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, schema: str, keys: list[str], error: str, batches: int = 4) -> DataFrame:
    """All rows of ``work`` through ``step``, in batches that are each appended to the checkpoint at ``path``.

    What a checkpoint holds without an error isn't done again, however often and wherever the job stopped;
    failed rows are. Batches are split by the hash of the keys, so the checkpoint is read and what is left to do written once, before the
    first; the result is the latest row of each key.
    """
    spark.createDataFrame([], schema + ", batch int").write.mode("append").parquet(path)
    prior = lambda: spark.read.schema(schema + ", batch int").parquet(path)
    start = prior().agg(F.coalesce(F.max("batch"), F.lit(-1)) + 1).first()[0]
    todo = scratch.kept(assemble.pending(work, prior(), keys, error).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(batches))))
    for i in range(batches):
        sinks.append_checkpoint(step(todo.where(F.col("_part") == i).drop("_part")), path, start + i)
    done = prior()
    last = done.groupBy(*keys).agg(F.max_by(F.struct(*done.columns), "batch").alias("r")).select("r.*").drop("batch")
    return last.join(work.select(*keys), keys, "left_semi")


def settled(stages: dict[str, Callable[[], object]], width: int = 4) -> dict[str, object]:
    """Runs all stages side by side to their end; raises afterwards if any failed."""
    results, failures = {}, {}
    with ThreadPoolExecutor(width) as pool:
        futures = {name: pool.submit(f) for name, f in stages.items()}
    for name, future in futures.items():
        if future.exception():
            failures[name] = future.exception()
        else:
            results[name] = future.result()
    if failures:
        raise RuntimeError("failed stages: " + "; ".join(f"{k}: {v}" for k, v in failures.items()))
    return results
