"""Contributions of features to a tree forecast against all subsets of the features."""

from __future__ import annotations

import random
from itertools import combinations
from math import factorial

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from furrow.operators import explain

NAMES = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(k, *(float(rng.randint(0, 9)) if n < 2 else rng.uniform(-5, 5) for n in range(4))) for k in range(400)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double")


@pytest.fixture(scope="module")
def fitted(table):
    vector = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(
        table.withColumn("y", F.col("a") * F.col("b") + F.col("c") * F.col("c") - 2 * F.col("a")))
    return GBTRegressor(featuresCol="features", labelCol="y", maxIter=6, maxDepth=4, stepSize=0.3, subsamplingRate=0.8,
                        seed=3).fit(vector)


def by_subsets(nodes, x):
    """Base, forecast and contributions by the definition: every subset of the features, every tree walked down."""
    trees = {}
    for r in nodes:
        trees.setdefault(r["tree"], {})[r["node"]] = r

    def expected(tree, at, known):
        node = tree[at]
        if node["left"] < 0:
            return node["weight"] * node["value"]
        if node["feature"] in known:
            return expected(tree, node["left"] if x[node["feature"]] <= node["threshold"] else node["right"], known)
        left, right = (tree[node[side]]["rows"] * expected(tree, node[side], known) for side in ("left", "right"))
        return (left + right) / node["rows"]

    n = len(x)
    game = {s: sum(expected(t, 0, s) for t in trees.values()) for k in range(n + 1) for s in map(frozenset, combinations(range(n), k))}
    added = [sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (game[s | {i}] - v)
                 for s, v in game.items() if i not in s) for i in range(n)]
    return game[frozenset()], game[frozenset(range(n))], added


def test_contributions_equal_all_subsets(spark, table, rows, fitted):
    nodes = explain.node_table(fitted, spark).collect()
    found = {r["id"]: r for r in explain.contributions(table.repartition(5), fitted, ["id"], NAMES).collect()}
    assert len(found) == 400
    for k, *x in rows[:40]:
        base, forecast, added = by_subsets(nodes, x)
        r = found[k]
        assert r["base"] == pytest.approx(base) and r["tree_forecast"] == pytest.approx(forecast)
        got = {d["feature"]: d["contribution"] for d in r["drivers"]}
        assert [got[f] for f in NAMES] == pytest.approx(added, abs=1e-9)
        sizes = [abs(d["contribution"]) for d in r["drivers"]]
        assert sizes == sorted(sizes, reverse=True)


def test_base_and_contributions_add_up_to_the_models_prediction(table, fitted):
    scored = fitted.transform(VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(table))
    both = explain.contributions(table, fitted, ["id"], NAMES).join(scored.select("id", "prediction"), "id")
    assert both.filter(F.abs(F.col("tree_forecast") - F.col("prediction")) > 1e-9).count() == 0


def test_importance_is_the_mean_of_the_rows(table, fitted):
    explained = explain.contributions(table, fitted, ["id"], NAMES)
    found = {r["feature"]: r for r in explain.importance(explained).collect()}
    assert set(found) == set(NAMES) and {r["n"] for r in found.values()} == {400}
    sizes = [abs(d["contribution"]) for r in explained.collect() for d in r["drivers"] if d["feature"] == "a"]
    assert found["a"]["mean_size"] == pytest.approx(sum(sizes) / 400)
    assert max(found, key=lambda f: found[f]["mean_size"]) in ("a", "b") and found["d"]["mean_size"] < found["a"]["mean_size"]
    top = explain.drivers(explained, ["id"], 2)
    assert top.count() == 800 and {r["rank"] for r in top.collect()} == {1, 2}


def test_odd_rows(spark, table, fitted):
    nan = float("nan")
    odd = spark.createDataFrame([(1, None, 1.0, 1.0, 1.0), (2, nan, 1.0, 1.0, 1.0), (2, nan, 1.0, 1.0, 1.0),
                                 (None, 1.0, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double")
    found = explain.contributions(odd, fitted, ["id"], NAMES).collect()
    assert len(found) == 4 and [(r["tree_forecast"], r["drivers"]) for r in found if r["id"] == 1] == [(None, [])]
    scored = fitted.transform(VectorAssembler(inputCols=list(NAMES), outputCol="features", handleInvalid="keep").transform(
        odd.filter("id = 2"))).collect()
    assert [r["tree_forecast"] for r in found if r["id"] == 2] == pytest.approx([r["prediction"] for r in scored])
    assert explain.contributions(table.limit(0), fitted, ["id"], NAMES).count() == 0


def test_the_size_of_the_tables_is_checked(spark, fitted):
    with pytest.raises(ValueError, match="bytes"):
        explain.explainer(explain.node_table(fitted, spark), 4, table_bytes=1_000)
