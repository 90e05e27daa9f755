"""Cases in which an operator once did less than the whole job."""

import random

import numpy as np
from pyspark.sql import functions as F

from podium.llm import language_crf, secret_forest, toxicity


def _noise(seed, rows, size):
    draw = random.Random(seed)
    return [(i, "".join(draw.choices("abcdefghijklmnopqrstuvwxyz 0123456789", k=size))) for i in range(rows)]


def test_toxicity_keeps_every_gram(spark):
    docs = spark.createDataFrame(_noise(1, 100, 800), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    text = docs.join(labels.withColumnRenamed("toxic", "label"), "doc_id")
    counted = toxicity.class_counts(toxicity.gram_counts(text.withColumn("half", F.lit(0))), 0, 1)
    grams, contexts = toxicity.log_ratios(counted)
    for table, frame, key in ((model.grams, grams, "gram"), (model.contexts, contexts, "context")):
        rows = frame.select(key, "ratio").toArrow()
        keys = rows[key].to_numpy().astype(np.int64).view(np.uint64)
        value, seen = table.find(keys)
        assert len(keys) > 10_000 and seen.all()
        assert np.allclose(value, rows["ratio"].to_numpy(), atol=1e-5)
        absent = np.setdiff1d(np.arange(2**39, 2**39 + 100_000, dtype=np.uint64), keys)
        assert not table.find(absent)[1].any()


def test_toxicity_by_joins(spark):
    docs = spark.createDataFrame(
        [*_noise(2, 60, 300), (60, None), (61, ""), (61, ""), (None, "short")], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    near, far = (
        sorted((r.doc_id or -1, r.score) for r in toxicity.score(docs, toxicity.train(docs, labels, **k)).collect())
        for k in ({}, {"broadcast_grams": 0})
    )
    assert len(near) == 64 and [x[0] for x in near] == [x[0] for x in far]
    assert np.allclose([x[1] for x in near], [x[1] for x in far], atol=1e-4)


LANGUAGES = {
    "en": "the quick brown fox jumps over that lazy dog while we were watching from this house",
    "de": "der schnelle braune fuchs springt über den faulen hund während wir aus dem haus zusahen",
    "fr": "le renard brun rapide saute par dessus ce chien paresseux pendant que nous regardions",
}


def _languages(spark, languages, repeat=1):
    rows = []
    for n, lang in enumerate(languages):
        words = LANGUAGES[lang].split()
        for i in range(40):
            random.Random(i).shuffle(words)
            rows.append((100 * n + i, " ".join(words * repeat), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_keeps_mixed_text(spark):
    half = {k: " ".join(v.split()[:9]) for k, v in LANGUAGES.items()}
    mixed = [(900, " ".join(half.values()), None), (901, "12 !? 34", None)]
    docs = _languages(spark, LANGUAGES).union(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))
    model = language_crf.train(docs)
    assert language_crf.predict(docs.filter("doc_id = 900"), model).first()["score"] < 0.5
    kept = {r.doc_id for r in language_crf.identify(docs).select("doc_id").collect()}
    assert 900 in kept and 901 not in kept and len(kept) == 121


def test_language_of_long_texts_only(spark):
    docs = _languages(spark, ["en", "fr"]).union(_languages(spark, ["de"], repeat=10).withColumn("doc_id", 500 + F.col("doc_id")))
    model = language_crf.train(docs, fit_chars=300)
    assert model.languages == ["de", "en", "fr"]
    found = language_crf.predict(docs, model)
    assert found.filter("lang_pred <> lang").count() == 0


def test_rare_format_is_a_secret(spark):
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    value = lambda n: "".join(draw.choices(letters, k=n)) + "7"
    rows = [(i, f"the commit {value(25)} of this week") for i in range(3000)]
    rare = [(9000, f"see glpat-{value(19)} there"), (9001, f"or xoxb-{value(20)} there")]
    docs = spark.createDataFrame(rows + rare, "doc_id long, text string")
    found = {r.doc_id: r for r in secret_forest.scan(docs).filter("doc_id >= 9000").collect()}
    assert {r.kind for r in found.values()} == {"gitlab_token", "slack_token"}
    assert all(r.secret for r in found.values())
