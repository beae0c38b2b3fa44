"""Exact Shapley values of boosted trees for every scored row: what each feature adds to a forecast.

A tree's expectation under a known subset of features follows a known feature's branch and averages the others by the
training rows that went either way. A leaf then is a product over the different features on its path: an interval that
the row meets or not, and the share of rows that its splits let through. Which intervals are met is one of 2^d patterns,
so the Shapley values of a leaf are a small table, made once; a row adds up the lines it hits. The tables grow with
the model (rounds x leaves x patterns), never with the rows, and their size is checked.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.forecast import FEATURES
from furrow.session import new_path

TABLE_BYTES = 64_000_000
ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class Paths:
    """Leaves whose paths split on the same number d of different features."""

    feature: np.ndarray  # (leaf, d) positions of the features
    low: np.ndarray      # (leaf, d) a value meets its interval if low < value <= high
    high: np.ndarray
    effect: np.ndarray   # (leaf, 2^d, d) what the k-th feature adds, by the pattern of met intervals


@dataclass(frozen=True)
class Explainer:
    """Expected forecast of the training rows and the effect tables of all leaves."""

    base: float
    paths: tuple[Paths, ...]
    n_features: int

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(row, feature) what each feature adds to the base; NaN goes right at every split, as when scoring."""
        x = np.where(np.isnan(x), np.inf, x)
        out = np.zeros((len(x), self.n_features))
        for at in range(0, len(x), ROWS_AT_ONCE):
            rows = x[at:at + ROWS_AT_ONCE]
            for p in self.paths:
                leaves, d = p.feature.shape
                code = np.zeros((len(rows), leaves), np.int64)
                for k in range(d):
                    value = rows[:, p.feature[:, k]]
                    code |= ((value > p.low[:, k]) & (value <= p.high[:, k])).astype(np.int64) << k
                hit = p.effect[np.arange(leaves), code]
                for k in range(d):
                    owner = np.zeros((leaves, self.n_features))
                    owner[np.arange(leaves), p.feature[:, k]] = 1
                    out[at:at + ROWS_AT_ONCE] += hit[:, :, k] @ owner
        return out


def _effects(value: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of every feature of every leaf for every pattern of met intervals.

    With z the shares and a subset S of the other met features known, a feature that is met (o = 1) or not (o = 0)
    changes the leaf's part of the expectation by value x (o - z) x the product of z over the features outside S.
    """
    leaves, d = share.shape
    out = np.zeros((leaves, 1 << d, d))
    for k in range(d):
        others = [j for j in range(d) if j != k]
        # What each subset of the other features adds, before asking whether the row meets it.
        weighted = {}
        for subset in range(1 << d):
            if not subset >> k & 1:
                size = subset.bit_count()
                rest = [j for j in others if not subset >> j & 1]
                weighted[subset] = factorial(size) * factorial(d - size - 1) / factorial(d) * share[:, rest].prod(axis=1)
        for pattern in range(1 << d):
            total = sum(w for subset, w in weighted.items() if subset & pattern == subset)
            out[:, pattern, k] = value * ((pattern >> k & 1) - share[:, k]) * total
    return out


def node_table(model: GBTRegressionModel, spark: SparkSession) -> DataFrame:
    """The fitted trees as rows (tree, node, weight, value, rows, left, right, feature, threshold); -1 is none."""
    path = new_path(spark, "model")
    model.save(path)
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.element_at(weights, F.col("treeID") + 1).alias("weight"),
        n["prediction"].alias("value"), n["impurityStats"][0].alias("rows"), n["leftChild"].alias("left"),
        n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"))


def explainer(nodes: DataFrame, n_features: int = len(FEATURES), table_bytes: int = TABLE_BYTES) -> Explainer:
    """Effect tables of all leaves of a node table, which is bounded by the model and comes to the driver."""
    trees = defaultdict(dict)
    for r in nodes.collect():
        trees[r["tree"]][r["node"]] = r
    base, leaves = 0.0, defaultdict(list)
    for tree in trees.values():
        # (node, feature -> [low, high, share])
        waiting = [(0, {})]
        while waiting:
            at, path = waiting.pop()
            node = tree[at]
            if node["left"] < 0:
                value = node["weight"] * node["value"]
                base += value * float(np.prod([share for _, _, share in path.values()]))
                leaves[len(path)].append((value, sorted(path.items())))
                continue
            f, cut = node["feature"], node["threshold"]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            part = tree[node["left"]]["rows"] / node["rows"]
            waiting.append((node["left"], {**path, f: (low, min(high, cut), share * part)}))
            waiting.append((node["right"], {**path, f: (max(low, cut), high, share * (1 - part))}))
    size = sum(8 * len(found) * d << d for d, found in leaves.items())
    if size > table_bytes:
        raise ValueError(f"effect tables of {size} bytes for this model, more than {table_bytes}")
    paths = []
    for d, found in sorted(leaves.items()):
        if d:
            parts = np.array([[interval for _, interval in path] for _, path in found])
            feature = np.array([[f for f, _ in path] for _, path in found])
            value = np.array([v for v, _ in found])
            paths.append(Paths(feature, parts[:, :, 0], parts[:, :, 1], _effects(value, parts[:, :, 2])))
    return Explainer(base, tuple(paths), n_features)


def contributions(features_table: DataFrame, model: GBTRegressionModel, keys: Sequence[str],
                  features: Sequence[str] = FEATURES) -> DataFrame:
    """Rows (keys, base, tree_forecast, drivers): the forecast of the trees and what each feature adds to the base.

    ``drivers`` holds (feature, value, contribution) by falling size of the contribution, ties by name; the
    contributions and the base add up to the forecast. Rows with a null feature, which the trees do not score, have a
    null forecast and no drivers. Repeated rows stay; an empty table gives an empty result. Nothing is shuffled.
    """
    spark = features_table.sparkSession
    found = explainer(node_table(model, spark), len(features))
    shipped = spark.sparkContext.broadcast(found)
    names = list(features)
    given = features_table.select(F.struct(*keys).alias("key"), *[F.col(f).cast("double").alias(f) for f in names])
    key = given.schema["key"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(1 + k) for k in range(len(names))]
            whole = ~np.any([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=0)
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns])
            added = list(shipped.value.contributions(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns,
                 pa.array([a if w else None for a, w in zip(added, whole)], pa.list_(pa.float64()))],
                ["key", *names, "added"])

    kinds = ", ".join(f"{f} double" for f in names)
    rows = given.mapInArrow(scan, f"key {key}, {kinds}, added array<double>")
    drivers = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col("added")[k].alias("contribution"))
                        for k, f in enumerate(names)])
    ordered = F.array_sort(drivers, lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(
        F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    total = F.aggregate("added", F.lit(found.base), lambda s, v: s + v)
    return rows.select("key.*", F.lit(found.base).alias("base"), total.alias("tree_forecast"),
                       F.when(F.col("added").isNotNull(), ordered).otherwise(F.array()).alias("drivers"))


def drivers(explained: DataFrame, keys: Sequence[str], k: int | None = None) -> DataFrame:
    """A row per key and driver with its rank; the ``k`` strongest, or all."""
    shown = F.col("drivers") if k is None else F.slice("drivers", 1, k)
    return explained.select(*keys, "base", "tree_forecast", F.posexplode(shown).alias("at", "d")).select(
        *keys, "base", "tree_forecast", (F.col("at") + 1).alias("rank"), "d.*")


def importance(explained: DataFrame) -> DataFrame:
    """Mean size and mean of each feature's contribution over all explained rows."""
    return explained.select(F.explode("drivers").alias("d")).groupBy(F.col("d.feature").alias("feature")).agg(
        F.count("*").alias("n"), F.avg(F.abs("d.contribution")).alias("mean_size"),
        F.avg("d.contribution").alias("mean_contribution"))
