from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import embeddings as E

from .conftest import union_find

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(dim=32, seed=0):
    """Unrelated vectors, a group of copies, a tight group of near copies, chains, and one scaled pair."""
    rng = np.random.default_rng(seed)
    rows = list(rng.standard_normal((120, dim)))
    rows += [rows[0]] * 40
    centre = rng.standard_normal(dim)
    rows += [centre + rng.standard_normal(dim) * 0.12 for _ in range(60)]
    for k in range(10):
        rows += [rows[10 + k] + rng.standard_normal(dim) * s for s in (0.2, 0.35, 0.5)]
    rows.append(3 * rows[5])
    order = rng.permutation(len(rows))
    return [rows[i].astype(np.float32).tolist() for i in order]


def brute(rows):
    x = np.array(rows, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    return near


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_against_all_pairs(spark):
    rows = vectors()
    near = brute(rows)
    roots = union_find([tuple(p) for p in np.argwhere(near).tolist()], range(len(rows)))
    got = result(E.near_duplicates(spark.createDataFrame([(k, v, k % 2) for k, v in enumerate(rows)], SCHEMA)))
    assert got == {k: (int(near[k].sum()), roots[k], roots[k] == k) for k in range(len(rows))}


def test_parts_of_a_hot_bucket_lose_no_pair(spark):
    df = E.classes(spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors(seed=1))], SCHEMA))
    whole = sorted(map(tuple, E.link_vectors(df).collect()))
    assert whole == sorted(map(tuple, E.link_vectors(df, cell=7).collect())) and len(whole) > 1000


def test_decode_lists_every_cap_above_the_height():
    caps = E.Caps(codewords=6, height=0.25, least=3)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn, words = caps.codes(16)
    grid = np.stack(np.meshgrid(*[np.arange(6)] * 4, indexing="ij"), axis=-1).reshape(-1, 4)
    filters = np.concatenate([words[b][grid[:, b]] for b in range(4)], axis=1)
    scores = x @ turn @ filters.T
    for row, found in enumerate(E.decode(x, caps)):
        above = set(np.flatnonzero(scores[row] >= 0.25).tolist())
        assert set(found.tolist()) == above if len(above) >= 3 else len(found) == 3
    assert np.allclose(np.linalg.norm(filters, axis=1), 1)


def test_bad_vectors_and_repeats(spark):
    nan, inf = float("nan"), math.inf
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 0.0]),
            (8, [1.0, 0.0]), (9, [2.0, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [-0.0, 5.0]), (13, [0.0, 0.0]),
            (14, [1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(k, v, None) for k, v in rows], SCHEMA)
    for name in ("rep", "n", "a", "b", "key", "root", "links", "dim"):
        df = df.withColumn(name, F.lit(1))
    got = result(E.near_duplicates(df))
    alone = {k: (0, k, True) for k in (1, 2, 3, 4, 5, 6, 11, 13, 14)}
    trio = {7: (3, 7, True), 8: (3, 7, False), 9: (3, 7, False), 10: (1, 10, True), 12: (1, 10, False)}
    assert {k: v for k, v in got.items() if k is not None} == alone | trio
    assert got[None][:2] == (3, 7)
    assert E.near_duplicates(df.filter("false")).count() == 0
    assert E.near_duplicates(df.filter("vec_id < 5")).filter("n_links > 0").count() == 0


@pytest.mark.parametrize("count", [50, 5_000, 5_000_000])
def test_candidates_grow_with_the_vectors(count):
    caps = E.caps_for(count, 64)
    total = caps.codewords ** 4
    assert 64 / total * count <= 4.5


@pytest.mark.parametrize("count", [10_000, 1_000_000, 30_000_000])
def test_pairs_at_the_threshold_meet(count):
    rng = np.random.default_rng(7)
    x, aside = rng.standard_normal((2, 300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    caps = E.caps_for(count, 64)
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(E.decode(x, caps), E.decode(y, caps))]
    assert np.mean(met) >= 0.97
