"""Held-out results of the trained operators on the driver's tables."""

from quadrille.llm import language_id, quality
from quadrille.llm.common import read

DATA = "/root/testdata/sf0.01"


def test_language(spark):
    docs = read(spark, DATA, "documents")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(found) > 100 and (found.lang_pred == found.lang).mean() > 0.97 and found.score.between(0, 1).all()


def test_quality(spark):
    found = quality.classify(read(spark, DATA, "documents"), read(spark, DATA, "labels"))
    found = found.join(read(spark, DATA, "labels"), "doc_id").filter("held_out").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.7 and found.score.between(0, 1).all()


def test_scores_depend_on_text_alone(spark):
    docs = read(spark, DATA, "documents").limit(50)
    model = language_id.train(language_id.training_rows(read(spark, DATA, "documents")))
    a = language_id.predict(docs, model).select("text", "lang_pred").collect()
    b = language_id.predict(docs.selectExpr("doc_id + 1 AS doc_id", "text", "'xx' AS lang"), model).select("text", "lang_pred").collect()
    assert sorted(a) == sorted(b)


def test_what_is_in_no_language_goes(spark):
    """Other scripts go, also in long texts and with numbers; learnt languages stay, however short or laden with keys."""
    docs = read(spark, DATA, "documents").select("doc_id", "text", "lang")
    some = docs.orderBy("doc_id").limit(40).collect()
    own = [(10**9 + i, r.text, r.lang) for i, r in enumerate(some)]
    short = [(2 * 10**9 + i, " ".join(r.text.split()[:2]), None) for i, r in enumerate(some) if any(c.isalpha() for c in " ".join(r.text.split()[:2]))]
    keys = [(3 * 10**9 + i, " ".join(r.text.split()[:12]) + ' token = "40d78a45c418324758e099eb7cb89bc" 4734663219866878', None) for i, r in enumerate(some)]
    strange = ["λόγος και έργο", "слово и дело, " * 2000, "日本語の文章です 12"]
    foreign = [(4 * 10**9 + i, t, None) for i, t in enumerate(strange)]
    table = docs.unionByName(spark.createDataFrame(own + short + keys + foreign, docs.schema))
    kept = {r.doc_id for r in language_id.keep_identified(table).select("doc_id").collect()}
    assert {r[0] for r in own + short + keys} - kept == set()
    assert {r[0] for r in foreign} & kept == set()
    assert {r.doc_id for r in docs.filter("text rlike '[A-Za-z]'").select("doc_id").collect()} <= kept
