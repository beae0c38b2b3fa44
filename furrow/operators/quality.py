"""Data-quality checks; each answers for all columns in one pass and returns rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.config import VALUE_RANGES
from furrow.operators.quantiles import exact_quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def per_column(df: DataFrame, columns: Sequence[str], stats: Mapping[str, object]) -> DataFrame:
    """One aggregate over all columns, returned as one row per column with the named statistics.

    ``stats`` maps a statistic's name to a function from column name to aggregate.
    """
    one = df.agg(*[F.struct(*[f(c).alias(n) for n, f in stats.items()]).alias(c) for c in columns])
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("s")) for c in columns])
    return one.select(F.explode(listed).alias("x")).select("x.column", "x.s.*")


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Columns that are missing or have another type than expected, one row each."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [(f.name, f.dataType.simpleString(), actual.get(f.name, "missing"))
             for f in expected.fields if actual.get(f.name) != f.dataType.simpleString()]
    return df.sparkSession.createDataFrame(wrong, "column string, expected string, actual string")


def column_difference(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected column names the frame lacks."""
    missing = [(c,) for c in expected if c not in df.columns]
    return df.sparkSession.createDataFrame(missing, "column string")


def check_required(df: DataFrame, columns: Sequence[str], tolerance: float = 0.05) -> DataFrame:
    """Nulls per required column and whether they exceed the tolerated share of rows."""
    table = per_column(df, columns, {
        "total": lambda c: F.count(F.lit(1)), "nulls": lambda c: F.count_if(F.col(c).isNull())})
    return table.withColumn("critical", F.col("nulls") > F.col("total") * tolerance)


def check_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = VALUE_RANGES) -> DataFrame:
    """Values outside their range per column: count, share of present values, extremes."""
    present = {c: r for c, r in ranges.items() if c in df.columns}
    table = per_column(df, list(present), {
        "out_of_range": lambda c: F.count_if((F.col(c) < present[c][0]) | (F.col(c) > present[c][1])),
        "present": lambda c: F.count(c), "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double")})
    return table.withColumn("pct", F.try_divide(F.col("out_of_range") * 100.0, F.col("present")))


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Values beyond factor x IQR of the quartiles, per column, with the bounds."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    quartiles = exact_quantiles(df, columns, (0.25, 0.75))
    bounds: dict[str, tuple[Column, Column]] = {}
    for c, (q1, q3) in quartiles.items():
        spread = None if q1 is None else (q3 - q1) * factor
        low, high = (None, None) if spread is None else (q1 - spread, q3 + spread)
        bounds[c] = (F.lit(low).cast("double"), F.lit(high).cast("double"))
    table = per_column(df, columns, {
        "outliers": lambda c: F.count_if((F.col(c) < bounds[c][0]) | (F.col(c) > bounds[c][1])),
        "present": lambda c: F.count(c),
        "lower_bound": lambda c: F.any_value(bounds[c][0]), "upper_bound": lambda c: F.any_value(bounds[c][1])})
    return table.withColumn("pct", F.try_divide(F.col("outliers") * 100.0, F.col("present")))


def completeness(df: DataFrame, minimum: float = 0.95) -> DataFrame:
    """Missing cells by column, with the share present over the whole table in every row."""
    table = per_column(df, df.columns, {
        "rows": lambda c: F.count(F.lit(1)), "missing": lambda c: F.count_if(F.col(c).isNull())})
    whole = table.agg(F.sum("missing").alias("missing_cells"), F.sum("rows").alias("total_cells"))
    total = whole.select(F.col("total_cells")).scalar()
    missing = whole.select(F.col("missing_cells")).scalar()
    share = 1 - F.try_divide(missing.cast("double"), total)
    return table.withColumns({"total_cells": total, "missing_cells": missing, "completeness": share,
                              "is_valid": share >= minimum})


def duplicates(df: DataFrame, keys: Sequence[str] = ("date", "fips")) -> DataFrame:
    """Rows beyond the first per key; null keys count as equal."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")).withColumn(
        "is_valid", F.col("duplicates") == 0)


def sigma_outliers(df: DataFrame, column: str, sigmas: float = 3.0) -> DataFrame:
    """Rows further than ``sigmas`` population standard deviations from the mean."""
    mean = df.agg(F.avg(column)).scalar()
    std = df.agg(F.stddev_pop(column)).scalar()
    return df.filter(F.abs(F.col(column) - mean) > std * sigmas)


def freshness(df: DataFrame, now: Column, date: str = "date", limit: int = 7,
              by: Sequence[str] = ()) -> DataFrame:
    newest = df.groupBy(*by).agg(F.max(date).alias("newest"))
    age = F.datediff(now, F.col("newest"))
    return newest.withColumn("age_days", age).withColumn("stale", age > limit)


def training_ranges(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of lowest and highest training value per feature."""
    return features.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns])


def out_of_training_range(df: DataFrame, ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with the list of features outside their training range."""
    marks = []
    for c in columns:
        bound = ranges.select(F.col(c)).scalar()
        value = F.col(c)
        marks.append(F.when((value < bound["lo"]) | (value > bound["hi"]), F.lit(c)))
    return df.withColumn("extrapolated", F.array_compact(F.array(*marks)))
