from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import cotraining
from furrow.llm.toxicity import held_out

from .conftest import ODD, frame


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnopqrs", k=rng.randint(2, 9))) for _ in range(600)]
    texts, labels = [], []
    for k in range(600):
        good = k % 3 != 0
        body = rng.choices(words, k=rng.randint(40, 150))
        if not good:
            body = [rng.choice([w.upper() + "!!", w + "###", "| " + w]) for w in body] if k // 3 % 8 < 4 else [body[0]] * 80
        texts.append(". ".join(" ".join(body[i:i + 9]) for i in range(0, len(body), 9)))
        if k % 4 == 0:
            labels.append((k, int(good), 0))
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_rows_that_no_label_covers(corpus):
    docs, labels = corpus
    scored = cotraining.score(docs, cotraining.learn(docs, labels)).collect()
    right = sum((r["score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in scored)
    assert len(scored) == 600 and right >= 585


def test_pool_rows_teach_the_other_view():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 900)
    content = rng.standard_normal((900, 6)) + 1.6 * y[:, None]
    metadata = rng.standard_normal((900, 4)) + 1.2 * y[:, None]
    label = np.where(np.arange(900) < 40, y, -1)
    alone = cotraining.co_train(content, metadata, label, rounds=0)
    taught = cotraining.co_train(content, metadata, label, rounds=6)
    def error(m):
        return ((m.scores(content[40:], metadata[40:])[2] >= 0.5) != y[40:]).mean()
    assert error(taught) <= error(alone) and error(taught) < 0.05


def test_held_out_labels_are_not_used(corpus):
    docs, labels = corpus
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = cotraining.learn(docs, labels), cotraining.learn(docs.repartition(3), flipped)
    assert np.allclose(one.content, two.content) and np.allclose(one.metadata, two.metadata)


def test_odd_rows(odd, none, corpus):
    docs, labels = corpus
    model = cotraining.learn(docs, labels)
    rows = cotraining.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert cotraining.score(none, model).count() == 0
    assert cotraining.learn(none, labels.filter("false")) is None
    assert {r["score"] for r in cotraining.score(odd, None).collect()} == {0.5}


def plain_views(docs):
    rows = docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    found = [cotraining._both(r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows]
    return rows, *(np.array([v[k] for v in found]).astype(np.float32).astype(float) for k in (0, 1))


def test_rounds_on_spark_equal_rounds_over_arrays(corpus):
    docs, labels = corpus
    known = {r["doc_id"]: r["quality"] for r in labels.filter(~held_out(F.col("doc_id"))).collect()}
    rows, content, metadata = plain_views(docs)
    plain = cotraining.co_train(content, metadata, np.array([known.get(r["doc_id"], -1) for r in rows]))
    for found in (cotraining.learn(docs, labels), cotraining.learn(docs.repartition(7), labels)):
        assert np.allclose(found.content, plain.content, atol=1e-6) and np.allclose(found.metadata, plain.metadata, atol=1e-6)
        assert np.allclose(found.joint, plain.joint, atol=1e-6)


def test_handed_rows_by_a_row_at_a_time_version():
    rng = np.random.default_rng(5)
    views = [rng.standard_normal((400, 5)), rng.standard_normal((400, 3))]
    history = [cotraining.Handing((rng.standard_normal(5), rng.standard_normal(3)), (-2.0, -1.5), (1.8, 1.6)) for _ in range(3)]
    found = cotraining.handed(views, history)
    for k in range(400):
        given = [None, None]
        for past in history:
            for own in (0, 1):
                logit = float(views[own][k] @ past.weights[own])
                if given[1 - own] is None and (logit < past.below[own] or logit >= past.above[own]):
                    given[1 - own] = float(logit >= past.above[own])
        assert [None if np.isnan(g[k]) else g[k] for g in found] == given


def test_thresholds_bound_the_share():
    logits = np.random.default_rng(6).normal(0, 6, 5_000)
    counts = cotraining._counts([np.ones(1)])([logits[:, None]])[0][0]
    below, above = cotraining._thresholds(counts, 0.05, 0.9)
    near = 0.05 * len(logits)
    assert near <= (logits < below).sum() <= 1.1 * near and near <= (logits >= above).sum() <= 1.1 * near
    assert cotraining._thresholds(counts, 0.9, 0.9) == pytest.approx((-np.log(9), np.log(9)))


@pytest.fixture(scope="module")
def moved(spark):
    """Pages whose layout tells their quality; the labelled ones are written in other letters than the rest."""
    rng = random.Random(21)

    def page(k, letters):
        good = k % 2 == 0
        body = ["".join(rng.choices(letters[:13] if good else letters[13:], k=5)) for _ in range(120)]
        return (". " if good else "\n").join(" ".join(body[i:i + 6]) for i in range(0, 120, 6))

    old, new = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψωϊϋ"
    docs = frame(spark, [page(k, old if k < 120 else new) for k in range(720)])
    return docs, spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(120)], "doc_id long, quality int")


def test_the_exchange_teaches_what_no_label_shows(moved):
    docs, labels = moved

    def right(rounds):
        scored = cotraining.score(docs, cotraining.learn(docs, labels, rounds=rounds)).filter("doc_id >= 120").collect()
        return np.mean([(r["content_score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in scored])

    assert right(0) < 0.9 and right(4) > 0.97


def test_repeated_rows_of_a_labelled_document_teach_once(corpus):
    docs, labels = corpus
    again = docs.filter("doc_id = 0")
    for _ in range(4):
        again = again.unionByName(again)
    one, two = cotraining.learn(docs, labels), cotraining.learn(docs.unionByName(again), labels)
    assert np.allclose(one.content, two.content) and np.allclose(one.joint, two.joint)
