import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.stats import sign_test


def one(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_normalized(spark):
    cases = {None: "", "": "", "Élan": "e lan", "straße": "stra e", "3.5.2": "3.5 2", ".5": "5", "v1.2a": "v1.2 a", "ﬁne ½ x² Ａ１": "fine 1 2 x2 a1", "İstanbul": "i stanbul", "áb": "a b", "…5": "5", "ǖ": "u"}
    assert one(spark, list(cases), T.normalized) == list(cases.values())


def test_normalized_follows_unicode(spark):
    rng = range(0x80, 0x2500)
    values = [f"a{chr(c)}1" for c in rng if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    want = [" ".join(re.findall(T.TOKEN, unicodedata.normalize("NFKD", v).lower())) for v in values]
    got = one(spark, values, T.normalized)
    wrong = [(v, a, b) for v, a, b in zip(values, want, got, strict=True) if a != b]
    assert not wrong, wrong[:10]


def test_containment(spark):
    rows = spark.createDataFrame([("1", "2019 12"), ("", "x"), ("a b", "x a bc"), ("b", None)], "g string, c string")
    assert [r[0] for r in rows.select(T.holds(T.normalized(F.col("g")), T.normalized(F.col("c")))).collect()] == [True, False, True, False]


def test_relaxed(spark):
    cases = [("", "a", False), ("a", "b a", True), ("a", "b", False), ("a b", "zzz", True), ("a b a b", "a b", False), ("a b a b", "a b a", True), ("a b c d", "a b x c d", True), ("a b c d", "d c b a", False)]
    rows = spark.createDataFrame(cases, "g string, e string, want boolean").select(T.relaxed_holds(T.tokens(F.col("g")), T.tokens(F.col("e"))).alias("y"), "want").collect()
    assert [r.y for r in rows] == [r.want for r in rows]


def test_small_functions(spark):
    assert one(spark, ["Model-4o mini!", "__a__"], T.column_slug) == ["model_4o_mini", "a"]
    assert one(spark, ["a/b:c.d_e", "--x--"], T.file_slug) == ["a-b-c.d_e", "x"]
    assert one(spark, ['```json\n{"a": {"b": 1}}\n```', "none", "x {1} y {2} z"], T.json_object) == ['{"a": {"b": 1}}', None, "{1} y {2}"]
    label = lambda x: T.leading_label(x, ("Entailment", "Contradiction"))
    assert one(spark, ["entailment: because", "True/Entailment", " CONTRADICTION", "Entailments"], label) == ["Entailment", None, "Contradiction", None]
    assert one(spark, ["a\n ... \nb\n...\nc", "x ... y"], T.excerpts) == [["a", "b", "c"], ["x ... y"]]
    assert one(spark, ["http://a/b/c//", "z"], T.last_segment) == ["c", "z"]
    assert one(spark, ["bench-000017", "x"], T.trailing_ordinal) == [17, None]
    assert one(spark, ["   x \t", ""], T.stripped) == ["x", ""]
    assert one(spark, [None, "NaN", "x"], T.cleaned) == ["", "", "x"]
    assert one(spark, ["1.5", "nan", "x", None], T.as_number) == [1.5, None, None, None]
    assert one(spark, ["none", "low"], T.effort) == ["not_requested", "low"]
    ids = spark.createDataFrame([("d", None, 3)], "a string, b int, c int")
    assert ids.select(T.compound_id(F.col("a"), F.col("b"), F.col("c")), T.compound_id(F.col("a"), F.col("b"), F.col("c"), keep_missing=True)).first()[:] == ("d|3", "d||3")


def test_sign_test(spark):
    cases = [(0, 0, 1.0), (5, 5, 1.0), (734, 450, 1.4097104655e-16), (611, 343, 3.26802976e-18), (1, 0, 1.0), (10, 0, 2 / 1024), (100_000, 101_000, None)]
    rows = spark.createDataFrame(cases, "w long, l long, p double").select(sign_test(F.col("w"), F.col("l")).alias("y"), "p").collect()
    for r in rows:
        assert r.p is None and 0 < r.y < 1 or r.y == pytest.approx(r.p, rel=1e-6)
