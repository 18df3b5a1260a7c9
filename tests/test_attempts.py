"""Rows that fail come again later, each attempt once, also after a restart and a batch that runs again."""

import glob
import os
import uuid
from collections import Counter

import pandas as pd

from quillon.streaming import attempts

WORK = "query_id string, question string"
DONE = "query_id string, answer string, error string"


def step(log, fails):
    def run(batches):
        for df in batches:
            errors = []
            for q in df["query_id"]:
                tries = len(glob.glob(f"{log}/{q}-*"))
                open(f"{log}/{q}-{uuid.uuid4().hex}", "w").close()
                errors.append("" if tries >= fails[q] else "Transient")
            yield pd.DataFrame({"query_id": df["query_id"], "answer": df["question"].str.upper(), "error": errors})

    return lambda df: df.mapInPandas(run, DONE)


def test_attempts_are_timed_kept_and_never_sent_twice(spark, tmp_path):
    work, path, log = (str(tmp_path / x) for x in ("work", "out", "log"))
    os.mkdir(log)
    fails = {f"q{i}": i % 3 for i in range(6)} | {"hopeless": 9, "late": 0}
    calls = lambda: Counter(os.path.basename(f).split("-")[0] for f in glob.glob(f"{log}/*"))
    put = lambda ids: spark.createDataFrame([(q, f"text {q}") for q in ids], WORK).coalesce(1).write.mode("append").parquet(work)
    start = lambda: attempts.retried(spark.readStream.schema(WORK).parquet(work), step(log, fails), path, ["query_id"], "error", most=3, wait_ms=300, every="200 milliseconds")

    put([q for q in fails if q != "late"] + ["q0", "q2"])
    got = {r.query_id: r for r in attempts.settled(start(), spark, path, DONE, 7, 150).collect()}
    assert {q: r.attempts for q, r in got.items()} == {q: min(n + 1, 3) for q, n in fails.items() if q != "late"}
    assert {q for q, r in got.items() if r.error} == {"hopeless"} and got["q4"].answer == "TEXT Q4"
    once = calls()
    assert once == {q: min(n + 1, 3) for q, n in fails.items() if q != "late"}

    # the driver is lost before it says that a batch with replies is done: the batch runs again and asks nothing
    batches = sorted(int(f.rpartition("=")[2]) for f in glob.glob(f"{path}/answered/batch=*"))
    for f in glob.glob(f"{path}/state/commits/*") + glob.glob(f"{path}/state/commits/.*.crc"):
        number = os.path.basename(f).strip(".").removesuffix(".crc")
        if number.isdigit() and int(number) >= batches[-1]:
            os.remove(f)
    for f in glob.glob(f"{path}/state/offsets/*") + glob.glob(f"{path}/state/offsets/.*.crc"):
        number = os.path.basename(f).strip(".").removesuffix(".crc")
        if number.isdigit() and int(number) > batches[-1]:
            os.remove(f)
    put(["late", "q1"])
    rows = attempts.settled(start(), spark, path, DONE, 8, 150).collect()
    assert sorted(r.query_id for r in rows) == sorted(fails)
    assert calls() == once | {"late": 1}
