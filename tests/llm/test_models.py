"""Toxicity and quality: held-out accuracy, and what odd rows give."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from purchase_insights.llm import quality, toxicity
from purchase_insights.llm.sampling import fold, sample_ids, with_texts

SCHEMA = "doc_id long, text string, toxic string, score string, stat_n_chars int, spans int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(1500)]
    docs, labels = [], []
    for doc_id in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        toxic, good = rng.random() < 0.15, rng.random() < 0.7
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(len(text))] = rng.choice(["vilefoul", "zzgrub", "zzgrubbing", "krakk"])
        text = " ".join(text)
        if not good:
            text = rng.choice([text.upper(), "$ ".join(text.split()), " ".join([text[:9]] * 30)])
        docs.append((doc_id, text, "x", "y", 1, 2))
        if doc_id % 4:
            labels.append((doc_id, int(good), int(toxic), "z"))
    docs = spark.createDataFrame(docs, SCHEMA).repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").repartition(3)


ODD = [(-1, None), (-2, ""), (-3, "zzgrub " * 40_000), (-4, "same"), (-4, "same"), (None, "no id"), (-5, "\x00 ß 😀")]


def accuracy(scored, labels, column):
    held = scored.where("doc_id % 5 = 0").join(labels.select("doc_id", F.col(column).alias("label")), "doc_id")
    return held.agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]


def test_toxicity(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels.where("doc_id % 5 <> 0"), steps=150)
    scored = toxicity.score(docs, model)
    assert accuracy(scored, labels, "toxic") > 0.97
    odd = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in ODD], SCHEMA)
    rows = toxicity.score(odd, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.doc_id: r.predicted for r in rows}[-3] == 1
    clean = toxicity.without_toxic(odd, model)
    assert clean.columns == odd.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in rows if not r.predicted)
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_risk_and_its_slope():
    """The estimate against its definition, document by document, and the slope against finite differences."""
    rng = np.random.default_rng(4)
    signs = set()
    for _ in range(40):
        n = int(rng.integers(4, 12))
        is_toxic = np.arange(n) < rng.integers(1, n)
        share = np.where(is_toxic, 1 / is_toxic.sum(), 1 / (~is_toxic).sum())
        z, prior = rng.normal(size=n) * 3, rng.uniform(0.05, 0.5)

        def parts(z):
            def loss(x, label):
                return math.log1p(math.exp(-x if label else x))

            toxic = [x for x, t in zip(z, is_toxic) if t]
            other = [x for x, t in zip(z, is_toxic) if not t]
            missed = prior * sum(loss(x, 1) for x in toxic) / len(toxic)
            return missed, sum(loss(x, 0) for x in other) / len(other) - prior * sum(loss(x, 0) for x in toxic) / len(toxic)

        missed, corrected, slope = toxicity.estimated_risk(z, share, is_toxic, prior)
        assert (missed, corrected) == pytest.approx(parts(z))
        signs.add(corrected >= 0)
        for i in range(n):
            step = np.eye(n)[i] * 1e-6
            high, low = parts(z + step), parts(z - step)
            change = (high[1] - low[1]) / 2e-6
            assert slope[i] == pytest.approx(change + (high[0] - low[0]) / 2e-6 if corrected >= 0 else -change, abs=1e-6)
    assert signs == {True, False}


def test_scores_are_those_of_the_weights(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels, steps=40)
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 60").collect()}
    for row in toxicity.score(docs.where("doc_id < 60"), model).collect():
        words = set(re.findall(r"[^\W\d_]+", texts[row.doc_id].lower()))
        names = {name for w in words for name in (f"={w}", *(w[:n] for n in (3, 4, 5) if len(w) >= n))}
        bins = {zlib.crc32(name.encode()) % toxicity.BINS for name in names}
        z = model.bias + sum(model.weights.get(b, 0.0) for b in bins)
        assert row.score == pytest.approx(1 / (1 + math.exp(-z)))


def test_hot_ids_count_once(spark, corpus):
    """An id that holds most of the rows does not reach the driver as often, and does not outweigh the others."""
    docs, labels = corpus
    chosen = sample_ids(labels.where("toxic = 1").select("doc_id"), 1).first()["doc_id"]
    again = docs.where(F.col("doc_id") == chosen).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("copy")
    more = docs.union(again)
    picked = sample_ids(labels.select("doc_id"), 5000)
    assert with_texts(picked, more).count() == picked.count()
    before, after = (toxicity.train(d, labels, steps=20) for d in (docs, more))
    assert before.weights.keys() == after.weights.keys() and before.bias == pytest.approx(after.bias)
    assert quality.train(more, labels) == quality.train(docs, labels)


def test_toxicity_is_repeatable(corpus):
    docs, labels = corpus
    models = [toxicity.train(d, labels, steps=40) for d in (docs, docs.repartition(7))]
    assert models[0].weights.keys() == models[1].weights.keys()
    assert models[0].bias == pytest.approx(models[1].bias)


def test_toxicity_without_examples(spark, corpus):
    docs, labels = corpus
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.train(docs, some) is None
    assert toxicity.train(docs.limit(0), labels) is None
    assert toxicity.score(docs, None).agg(F.max("score")).first()[0] == 0
    assert toxicity.without_toxic(docs, None).count() == docs.count()


def test_quality(spark, corpus):
    docs, labels = corpus
    model = quality.train(docs, labels.where("doc_id % 5 <> 0"))
    scored = quality.score(docs, model)
    assert accuracy(scored, labels, "quality") > 0.95
    assert 0 < len(model.rules) < 200
    odd = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in ODD], SCHEMA)
    rows = quality.score(odd, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    good = quality.good(odd, model)
    assert good.columns == odd.columns
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(str(r.doc_id) for r in rows if r.predicted)
    plan = scored._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_compiled_rules(corpus):
    """The scores of the Spark columns are those of the rules in numpy on the same rows."""
    docs, labels = corpus
    model = quality.train(docs, labels)
    columns = quality.statistics(F.col("text"))
    rows = docs.select("doc_id", *(c.alias(n) for n, c in columns.items())).collect()
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert model.rules and rows
    for row in rows:
        z = model.bias
        for rule, weight in model.rules:
            z += weight * all((row[name] > at) == above for name, above, at in rule)
        assert scores[row.doc_id] == pytest.approx(1 / (1 + math.exp(-z)))


def test_lasso_is_a_minimum():
    """No small step along any weight lowers the penalised loss."""
    rng = np.random.default_rng(3)
    holds, y = (rng.random((300, 6)) < 0.4).astype(float), (rng.random(300) < 0.5).astype(float)
    y[holds[:, 0] > 0] = 1
    weights, bias = quality._lasso(holds, y, penalty=0.01)

    def loss(theta):
        z = holds @ theta[:-1] + theta[-1]
        return np.mean(np.logaddexp(0, z) - y * z) + 0.01 * np.abs(theta[:-1]).sum()

    theta = np.append(weights, bias)
    steps = [k * np.eye(7)[i] for i in range(7) for k in (0.02, -0.02)]
    assert all(loss(theta + step) >= loss(theta) - 1e-6 for step in steps) and 0 < (weights != 0).sum() < 6


def test_quality_without_both_kinds(spark, corpus):
    docs, labels = corpus
    assert quality.train(docs, labels.limit(0)).rules == []
    assert quality.good(docs, quality.train(docs, labels.limit(0))).count() == docs.count()
    assert quality.score(docs, quality.train(docs, labels.where("quality = 0"))).agg(F.max("score")).first()[0] < 0.01


def test_statistics(spark):
    row = spark.createDataFrame([("AB cd! cd\n1|.$",)], "text string")
    found = row.select(*(c.alias(n) for n, c in quality.statistics(F.col("text")).items())).first().asDict()
    assert found["n_chars"] == 14 and found["n_words"] == 4 and found["n_lines"] == 2
    assert found["upper"] == pytest.approx(2 / 14) and found["symbols"] == pytest.approx(1 / 14)
    assert found["new_words"] == 1.0


def test_samples_and_folds(spark):
    ids = spark.createDataFrame([(k % 50, k) for k in range(100)] + [(None, 1)], "doc_id long, value int")
    picked = [sample_ids(d, 20).collect() for d in (ids, ids.repartition(6))]
    assert picked[0] == picked[1] and len({r.doc_id for r in picked[0]}) == 20
    rows = spark.range(20).select(F.col("id").alias("doc_id")).select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert [r.f for r in rows] == [zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows]
