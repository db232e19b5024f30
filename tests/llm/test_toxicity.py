import math
import random
import zlib

import numpy as np
import pytest
from qualityframe.llm import toxicity
from qualityframe.llm.common import table


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(6)
    usual = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1500):
        toxic = k % 6 == 0
        words = rng.choices(usual, k=60)
        if toxic:
            for bad in rng.choices(["vile", "awful", "rotten"], k=3):
                words[rng.randrange(60)] = bad
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(made):
    docs, labels = made
    model = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    rows = toxicity.score(docs, *model).withColumn("held", toxicity.held_out()).where("held").collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    caught = [r["__score"] >= 0.7 for r in rows if truth[r.doc_id]]
    wrong = [r["__score"] >= 0.7 for r in rows if not truth[r.doc_id]]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.02 * len(wrong)
    assert 0 < (model[0] != 0).sum() < 2000  # sparse


def test_updates_equal_a_plain_loop():
    fit = toxicity.Fit(epochs=2, l1=0.8)
    rng = random.Random(7)
    rows = [(rng.randint(0, 1), np.unique(rng.choices(range(30), k=8)).astype(np.int32)) for _ in range(60)]
    weights, bias = toxicity.train(rows, fit)
    size, l1 = 1 << toxicity.BITS, fit.l1 * math.sqrt(len(rows))
    z, n = {}, {}

    def weight(i):
        zi, lim = z.get(i, 0.0), 0.0 if i == size else l1
        if abs(zi) <= lim:
            return 0.0
        return (math.copysign(lim, zi) - zi) / ((fit.beta + math.sqrt(n.get(i, 0.0))) / fit.alpha + fit.l2)

    for _ in range(fit.epochs):
        for label, found in rows:
            active = [*found.tolist(), size]
            w = {i: weight(i) for i in active}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in active:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / fit.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert bias == pytest.approx(weight(size))
    assert weights[:30] == pytest.approx([weight(i) for i in range(30)])


def test_labels_that_are_held_out_teach_nothing(spark, sample):
    """Turning every held-out label over changes no score."""
    docs = table(spark, sample, "documents")
    labels = table(spark, sample, "labels")
    assert toxicity.training_rows(labels.where(~toxicity.held_out()), toxicity.Fit()).where(toxicity.held_out()).count() == 0
    rows = toxicity.op5(spark, sample).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_odd_rows(spark, odd_docs, no_docs, made):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (99, 1)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    none = labels.limit(0)
    assert toxicity.drop_toxic(odd_docs, none).count() == odd_docs.count()
    assert {r["__score"] for r in toxicity.score(odd_docs, *toxicity.learn(odd_docs, none)).collect()} == {0.5}
    assert toxicity.drop_toxic(no_docs, labels).count() == 0
