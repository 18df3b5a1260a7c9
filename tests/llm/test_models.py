import numpy as np
from pyspark.sql import functions as F

from quillon.llm import langid, quality
from quillon.llm.common import held_out, table

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    rows = langid.op1_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 150 and (rows["lang"] == rows["lang_pred"]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


def test_language_mixtures(spark, docs, empty, odd):
    train = table(spark, SF, "documents").where(~held_out(F.col("doc_id")))
    model = langid.train(train)
    both = train.where("lang IN ('en', 'fr')").groupBy("lang").agg({"text": "max"}).collect()
    mixed = langid.infer(" ".join(r[1][:3000] for r in both), model[1])
    assert {model[0][i] for i, _ in mixed} >= {"en", "fr"} and abs(sum(s for _, s in mixed) - 1) < 1e-6
    got = {r.doc_id: r for r in langid.identify(docs, model, spark).collect()}
    assert [got[i].lang_pred for i in (1, 4, 7)] == ["und"] * 3 and got[1].score == 0.0 and not got[1].mixture
    assert got[10].lang_pred in model[0]
    assert langid.identify(empty, model, spark).count() == 0 and langid.identify(odd, model, spark).count() == 4
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(docs, none, spark).collect()} == {"und"}


def test_em_finds_the_shares():
    like = np.array([[0.9, 0.1], [0.1, 0.9]])
    share, _ = langid.proportions(like, np.array([700.0, 300.0]), rounds=2000)
    assert abs(share[0] - 0.75) < 0.02


def test_quality_of_held_out_documents(spark):
    rows = quality.op2_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    good, bad = rows[rows["quality"] == 1]["score"].to_numpy(), rows[rows["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.93
    assert (rows["predicted"] == rows["quality"]).mean() > 0.93
    assert ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()


def test_quality_edges(spark, docs, empty, odd):
    labels = spark.createDataFrame([(i * 3 + 1, i % 2, 0) for i in range(60)] + [(None, 1, 0), (1, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model, spark).toPandas()
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    kept = quality.keep_good(docs, model, spark)
    assert kept.columns == docs.columns and kept.count() == int(rows["predicted"].sum())
    assert quality.score(empty, model, spark).count() == 0 and quality.score(odd, model, spark).count() == 4
    prior = quality.train(docs, labels.where("quality = 1"))
    assert prior == {"w": None, "prior": 1.0} and quality.train(empty, labels)["prior"] == 0.5
    assert np.isfinite(quality.features("x" * 100_000)).all() and len(quality.features("")) == quality.N_FEATURES
