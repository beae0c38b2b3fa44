from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from furrow.llm import maxent
from furrow.llm.queries import QUERIES

from .conftest import frame

SMALL = maxent.Training(share=50, buckets=1 << 8)


def tokens(text):
    return re.findall("[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(d, h, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
             sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for (d, t), h in zip(rows, held)]


def close(found, rows):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found), key=repr)
    want = sorted(brute(rows), key=repr)
    assert len(got) == len(want)
    for one, other in zip(sorted(got, key=lambda r: (repr(r[:5]), r[5])), sorted(want, key=lambda r: (repr(r[:5]), r[5]))):
        assert one[:5] == other[:5] and one[5] == pytest.approx(other[5], rel=1e-9)


def corpus(size, seed=1):
    """Texts in which a word tells much of the next one, with words that occur once."""
    rng, words = random.Random(seed), [f"w{k}" for k in range(40)]
    out = []
    for k in range(size):
        at, text = rng.randrange(40), []
        for _ in range(rng.randint(1, 60)):
            at = (at * 7 + rng.choice([1, 2])) % 40 if rng.random() < 0.9 else rng.randrange(40)
            text.append(words[at].upper() if rng.random() < 0.2 else words[at] if rng.random() < 0.97 else f"rare{rng.randrange(10**6)}")
        out.append((k, " ".join(text)))
    return out


def test_scores(spark):
    rows = corpus(1500)
    found = maxent.score(frame(spark, rows).repartition(6), SMALL).collect()
    close(found, rows)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 200 and sum(r["score"] for r in held) > 0.75 * sum(r["base_score"] for r in held)
    again = {r["doc_id"]: r["score"] for r in maxent.score(frame(spark, rows), SMALL).collect()}
    assert np.corrcoef([r["score"] for r in found], [again[r["doc_id"]] for r in found])[0, 1] > 0.999999


def test_probabilities_add_up():
    """Over all outputs after any history, each factor and their product sum to one."""
    rng = np.random.default_rng(2)
    model = maxent.start(rng.integers(0, 50, 30).astype(float), 64)
    model.weights = tuple(rng.normal(0, 1, w.shape).astype(np.float32) for w in model.weights)
    history = rng.integers(0, 30, 2)
    ids = np.concatenate([np.append(history, k) for k in range(30)])
    p = 10 ** maxent.log_probabilities(model, ids, np.arange(3, 91, 3), 30).reshape(30, 3)[:, 2]
    assert p.sum() == pytest.approx(1, abs=1e-5) and (p > 0).all()


def test_the_unigram_model_is_the_start():
    totals = np.array([5.0, 100, 40, 30, 7, 1, 1])
    model = maxent.start(totals, 16)
    got = 10 ** maxent.log_probabilities(model, np.arange(7), np.array([7]), 7)
    assert got == pytest.approx((totals + 0.5) / (totals + 0.5).sum(), rel=1e-5)


def test_moments_against_a_plain_sum():
    rng = np.random.default_rng(5)
    model = maxent.start(rng.integers(1, 50, 12).astype(float), 32)
    model.weights = tuple(rng.normal(0, 1, w.shape).astype(np.float32) for w in model.weights)
    ids, ends = rng.integers(0, 12, 200), np.array([1, 50, 200])
    keys = maxent.features(*maxent.histories(ids, ends, 12))
    moments = maxent.Moments(model)
    moments.add(model, keys, ids)
    seen, expected = [np.zeros(w.shape) for w in model.weights], [np.zeros(w.shape) for w in model.weights]
    for factor, some, rows, column, p in maxent.factors(model, keys, ids):
        assert factor == 0 or (ids[some] != maxent.TAIL).all()
        for t in range(len(column)):
            for row in rows[:, t]:
                seen[factor][row, column[t]] += 1
                expected[factor][row] += p[t]
    for a, b in zip([*seen, *expected], [*moments.seen, *moments.expected]):
        assert a == pytest.approx(b, abs=1e-3)


def test_an_update_raises_the_probability():
    rng = np.random.default_rng(6)
    ids = np.cumsum(rng.integers(1, 3, 4000)) % 11
    ids[ids == maxent.TAIL] = 2
    ends, totals = np.array([1000, 4000]), np.bincount(ids, minlength=11).astype(float)
    model, last = maxent.start(totals, 128), -np.inf
    for _ in range(4):
        now = maxent.log_probabilities(model, ids, ends, 11).sum()
        assert now > last
        moments, last = maxent.Moments(model), now
        moments.add(model, maxent.features(*maxent.histories(ids, ends, 11)), ids)
        model = maxent.updated(model, moments.seen, moments.expected, SMALL)


def test_gradient_over_all_parts_is_that_of_all_texts(spark):
    texts, vocabulary = maxent.read(frame(spark, corpus(300)).repartition(5), SMALL)
    model, pad = maxent.start(vocabulary.totals, 64), len(vocabulary.totals)
    whole = maxent.gradient(texts, model, pad, 0, 1)
    parts = [maxent.gradient(texts, model, pad, k, 3) for k in range(3)]
    for side in (0, 1):
        for factor in (0, 1):
            assert whole[side][factor] == pytest.approx(sum(p[side][factor] for p in parts), rel=1e-3, abs=1e-2)
    assert whole[0][0].sum() == 3 * vocabulary.tokens and len(vocabulary.frequent) <= SMALL.share


def test_odd_rows(spark, odd, none, skewed):
    close(maxent.score(odd, SMALL).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert maxent.score(none, SMALL).count() == 0
    close(maxent.score(skewed, SMALL).collect(), [(r["doc_id"], r["text"]) for r in skewed.collect()])
    alone = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1)
    one = maxent.score(frame(spark, [(alone, "nothing to learn from")]), SMALL).first()
    assert one["held_out"] and one["train_tokens"] == 0 and one["n_known"] == 0 and one["base_score"] == 0 and np.isfinite(one["score"])


def test_query(spark, tmp_path):
    rows = corpus(200, 4)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_hashed_maxent"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"),
                          ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    close(got.collect(), rows)
