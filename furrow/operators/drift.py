"""Drift checks over all numeric columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.quality import per_column


def _z(mean: Column, reference: Column, std: Column) -> Column:
    return F.when(std > 0, (mean - reference) / std).otherwise(0.0)


def _overall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_column(df, columns, {"overall_mean": lambda c: F.avg(c), "overall_std": lambda c: F.stddev_samp(c)})


def temporal_drift(df: DataFrame, columns: Sequence[str], rows: int = 7, threshold: float = 2.0,
                   order: Sequence[str] = ("date", "fips")) -> DataFrame:
    """Mean of the last rows in date order against the whole column, in its standard deviations."""
    recent = df.select(*order, *[c for c in columns if c not in order]).orderBy(
        *[F.desc_nulls_last(c) for c in order]).limit(rows)
    recent = per_column(recent, columns, {"recent_mean": lambda c: F.avg(c)})
    z = _z(F.col("recent_mean"), F.col("overall_mean"), F.col("overall_std"))
    return recent.join(_overall(df, columns), "column").select(
        "column", "recent_mean", "overall_mean", z.alias("z_score"),
        (F.abs(z) > threshold).alias("has_drift"))


def group_drift(df: DataFrame, columns: Sequence[str], threshold: float = 2.0,
                expected: float | None = None, by: str = "fips") -> DataFrame:
    """Groups whose mean lies more than ``threshold`` overall deviations from the expected mean."""
    groups = df.groupBy(by).agg(*[
        F.struct(F.avg(c).alias("mean"), F.count(c).alias("n")).alias(c) for c in columns])
    long = groups.select(by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("x")
    ).select(by, "x.column", "x.s.mean", "x.s.n")
    overall = _overall(df, columns)
    target = F.col("overall_mean") if expected is None else F.lit(expected)
    z = _z(F.col("mean"), target, F.col("overall_std"))
    return (long.join(overall, "column").withColumn("z_score", z)
            .filter(F.abs("z_score") > threshold).select(by, "column", "mean", "z_score", "n"))


def missing_drift(df: DataFrame, columns: Sequence[str] | None = None, limit_pct: float = 10.0) -> DataFrame:
    """Columns with more than ``limit_pct`` percent nulls."""
    columns = df.columns if columns is None else columns
    return per_column(df, columns, {
        "missing_pct": lambda c: F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)) * 100,
    }).filter(F.col("missing_pct") > limit_pct)


def drift_report(df: DataFrame, columns: Sequence[str], rows: int = 7, threshold: float = 2.0,
                 group_threshold: float = 2.0) -> DataFrame:
    """The three checks as one table of findings (check, column, fips, mean, z_score, n, missing_pct)."""
    none = F.lit(None)
    temporal = temporal_drift(df, columns, rows, threshold).select(
        F.lit("temporal").alias("check"), "column", none.cast("string").alias("fips"),
        F.col("recent_mean").alias("mean"), "z_score", none.cast("long").alias("n"),
        none.cast("double").alias("missing_pct"), "has_drift")
    county = group_drift(df, columns, group_threshold).select(
        F.lit("county").alias("check"), "column", "fips", "mean", "z_score", "n",
        none.cast("double").alias("missing_pct"), F.lit(True).alias("has_drift"))
    missing = missing_drift(df, columns).select(
        F.lit("missing").alias("check"), "column", none.cast("string").alias("fips"),
        none.cast("double").alias("mean"), none.cast("double").alias("z_score"),
        none.cast("long").alias("n"), "missing_pct", F.lit(True).alias("has_drift"))
    return temporal.unionByName(county).unionByName(missing)
