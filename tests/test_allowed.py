"""What questions allow may be millions of ids in a small compressed table: no plan sends them to every task."""

import random
import re

from quillon.operators import checks, metrics, substring
from quillon.plans import pipelines

ASKED = "query_id string, golden_answer string, allowed_doc_ids array<string>"


def sent_lists(df):
    """Exploded ``allowed_doc_ids`` that the physical plan sends to every task: above them stands a broadcast, and no sorted merge before it."""
    above, found = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(re.match(r"[\s:|+\-*]*", line).group())
        while above and above[-1][0] >= depth:
            above.pop()
        above.append((depth, line[depth:]))
        if re.match(r"Generate (pos)?explode\(allowed_doc_ids", line[depth:]):
            found.append(next(x for _, x in reversed(above) if re.match("BroadcastExchange|SortMergeJoin", x)).split("(")[0])
    assert found
    return [x for x in found if "Broadcast" in x]


def written(spark, tmp_path, rows, schema):
    """A table whose file is as small as its rows, as the planner sees it."""
    path = f"{tmp_path}/{schema.split()[0]}"
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_full_document_sends_no_lists(spark, tmp_path):
    asked = written(spark, tmp_path, [("q", "a b", ["1", "2"])], ASKED)
    documents = written(spark, tmp_path, [("1", "x a"), ("2", "b y")], "doc_id string, text string")
    df = metrics.full_document(asked, documents)
    assert not sent_lists(df) and [tuple(r) for r in df.collect()] == [("q", True)]


def test_full_document_over_borders(spark):
    """Against the joined texts, with answers over several documents, empty and unknown documents, and documents allowed twice."""
    rng = random.Random(5)
    some = lambda most: " ".join(rng.choices(["a", "b", "ab", "cab", "d"], k=rng.randint(0, most)))
    texts = {f"d{i}": some(30 if i % 8 == 0 else 4) for i in range(40)}
    asked = []
    for i in range(300):
        ids = rng.choices([*texts, "nowhere"], k=rng.randint(0, 12))
        whole = " ".join(texts[d] for d in ids if d in texts)
        at = rng.randint(0, len(whole))
        asked.append((f"q{i}", some(5) if i % 3 == 0 else " ".join(whole[at : at + rng.randint(4, 20)].split()), ids))
    documents = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.query_id: r.exact_full for r in metrics.full_document(spark.createDataFrame(asked, ASKED), documents).collect()}
    want = {q: bool(g) and g in " ".join(texts[d] for d in ids if d in texts) for q, g, ids in asked}
    alone = {q: bool(g) and any(g in texts.get(d, "") for d in ids) for q, g, ids in asked}
    assert got == want
    assert sum(want.values()) - sum(alone.values()) > 10


def test_doc_filter_sends_no_lists(spark, tmp_path):
    asked = written(spark, tmp_path, [("q", "a", ["1", "2"]), ("r", "a", [])], ASKED)
    units = written(spark, tmp_path, [("u1", "1"), ("u2", "2")], "unit_id string, doc_id string")
    rows = [("q", [("u1", "1"), ("u2", "3")]), ("r", [("u9", "1")])]
    df = checks.doc_filter(spark.createDataFrame(rows, "query_id string, retrieved_items array<struct<unit_id: string, doc_id: string>>"), asked, units)
    assert not sent_lists(df) and {r["check"]: r.n_violations for r in df.collect()} == {"known_unit": 1, "allowed_document": 2}


def test_qrels_send_no_lists(spark, tmp_path):
    asked = written(spark, tmp_path, [("q", "the b c d e", ["1", "2", "4"]), ("r", "", ["3", "9"]), ("s", "b c d e f", [])], ASKED)
    texts = ["x the b c d e y", "b c d e", "g h i j", "b c d", "h b c d"]
    units = written(spark, tmp_path, [(f"u{i}", f"{i}", t) for i, t in enumerate(texts, 1)], "unit_id string, doc_id string, text string")
    df = metrics.substring_qrels(asked, units)
    assert not sent_lists(df) and sorted((r.query_id, r.unit_id) for r in df.collect()) == [("q", "u1"), ("q", "u2"), ("r", "u3")]


def test_units_that_lie_in_no_answer_go_before_their_keys(spark):
    """Of many short units, those whose first inner run no gold answer has are neither written nor are their runs sent to every task."""
    asked = spark.createDataFrame([("q", "z number7 and more x", ["d7"])], ASKED)
    units = spark.createDataFrame([(f"u{i}", f"d{i}", f"z number{i} and more") for i in range(40)], "unit_id string, doc_id string, text string")
    kept = []
    got = metrics.substring_qrels(asked, units, keep=lambda df: kept.append(df.count()) or df).collect()
    assert [(r.query_id, r.unit_id) for r in got] == [("q", "u7")] and max(kept) == 1


def test_possible_needles(spark):
    needles = spark.createDataFrame([(1, "a b c d"), (2, "a c b d"), (3, "x y"), (4, "bb a b c"), (5, "")], "needle_id long, needle string")
    texts = spark.createDataFrame([(1, "a b c d e"), (2, "")], "text_id long, text string")
    assert sorted(r.needle_id for r in substring.possible(needles, texts).collect()) == [1, 3, 4, 5]


def test_handoff_sends_no_lists(spark, tmp_path):
    """What the full documents hold is written once, by a plan without lists, and no plan of the results has the lists again."""
    asked = written(spark, tmp_path, [("q", "a b", ["1", "2"])], ASKED)
    documents = spark.createDataFrame([("1", "x a"), ("2", "b y")], "doc_id string, text string")
    item = "array<struct<rank: int, unit_id: string, doc_id: string, text: string, score: double>>"
    arm = spark.createDataFrame([("q", "m", "a b", [(1, "1", "1", "x a", 1.0)], "")], f"query_id string, arm string, golden_answer string, retrieved_items {item}, retrieval_error string")
    flags, curve, _ = pipelines.handoff(asked, documents, [arm], spark.createDataFrame([("q", "1")], "query_id string, unit_id string"))
    assert not any("allowed_doc_ids" in df._jdf.queryExecution().executedPlan().toString() for df in (flags, curve))
    assert flags.first().exact_full and curve.first().n_ceiling == 1
