"""Ordered operators over county series. Each window partition is one county's calendar, so bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("fips",)
SEASON_SERIES = ("fips", "year")


def rolling(df: DataFrame, column: str, rows: int = 7, by: Sequence[str] = SERIES, order: str = "date") -> DataFrame:
    """Trailing mean and sample std over ``rows`` rows, null until that many values are there."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    full = F.count(column).over(w) == rows
    return df.withColumns({
        f"{column}_roll_mean": F.when(full, F.avg(column).over(w)),
        f"{column}_roll_std": F.when(full, F.stddev_samp(column).over(w)),
    })


def rolling_days(df: DataFrame, column: str, days: int = 7, by: Sequence[str] = SERIES, date: str = "date") -> DataFrame:
    """Trailing mean over calendar days."""
    w = Window.partitionBy(*by).orderBy(F.unix_date(F.col(date))).rangeBetween(-(days - 1), 0)
    return df.withColumn(f"{column}_{days}d", F.avg(column).over(w))


def max_gap(df: DataFrame, by: Sequence[str] = SEASON_SERIES, date: str = "date") -> DataFrame:
    previous = F.lag(date).over(Window.partitionBy(*by).orderBy(date))
    return df.withColumn("__gap", F.datediff(date, previous)).groupBy(*by).agg(F.max("__gap").alias("max_gap_days"))


def spells(df: DataFrame, condition: Column, min_days: int = 7, by: Sequence[str] = SEASON_SERIES,
           date: str = "date") -> DataFrame:
    """Runs of at least ``min_days`` consecutive days on which the condition holds."""
    w = Window.partitionBy(*by).orderBy(date)
    runs = df.filter(condition).withColumn("__island", F.date_sub(date, F.row_number().over(w)))
    return (runs.groupBy(*by, "__island")
            .agg(F.min(date).alias("first_day"), F.max(date).alias("last_day"), F.count("*").alias("days"))
            .filter(F.col("days") >= min_days).drop("__island"))


def cumulative_features(weekly: DataFrame, pollination: tuple[int, int] = (27, 31),
                        week: str = "week_of_season") -> DataFrame:
    """Season-to-date features per county week.

    ``pollination`` is on the scale of the ``week`` column; the published feature
    list counts calendar-like weeks 21 to 40, so pass (7, 11) for season weeks.
    """
    so_far = Window.partitionBy("fips", "year").orderBy(week).rowsBetween(Window.unboundedPreceding, 0)
    flowering = F.col(week).between(*pollination)
    return weekly.select(
        "fips", "year", week,
        F.sum("water_deficit_mean").over(so_far).alias("cumsum_water_deficit"),
        F.sum("lst_days_above_32").over(so_far).alias("cumsum_heat_days"),
        F.sum("vpd_mean").over(so_far).alias("cumsum_vpd"),
        F.sum("pr_sum").over(so_far).alias("cumsum_precip"),
        F.max(F.when(flowering, F.col("lst_days_above_32"))).over(so_far).alias("max_heat_pollination"),
        F.col("ndvi_mean").alias("ndvi_current"),
        flowering.cast("int").alias("is_pollination"),
    )


def with_trend(df: DataFrame, index: str = "overall_stress_index", tolerance: float = 0.05,
               higher_is_better: bool = False) -> DataFrame:
    """Stable within 5 percent of the previous week, tested first; else improving or declining.

    The rule is written for a score where higher is healthier; for the stress
    index, where higher is worse, a rise counts as declining.
    """
    previous = F.lag(index).over(Window.partitionBy("fips", "year").orderBy("week_start"))
    now = F.col(index)
    better = now > previous if higher_is_better else now < previous
    trend = (F.when(previous.isNull() | now.isNull(), None)
             .when(F.abs(now - previous) <= F.abs(previous) * tolerance, "stable")
             .when(better, "improving").otherwise("declining"))
    return df.withColumn("previous_index", previous).withColumn("trend", trend)


def with_percentile(df: DataFrame, index: str = "overall_stress_index") -> DataFrame:
    """Percent rank of the week among the same week of other years in the county."""
    rank = F.percent_rank().over(Window.partitionBy("fips", "week_of_season").orderBy(index))
    return df.withColumn("historical_percentile", rank * 100)


def with_anomaly(df: DataFrame, normals: DataFrame, value: str, mean: str, std: str) -> DataFrame:
    """Standard deviations from the normal of the county's season week; null without a spread."""
    keys = ["fips", "week_of_season"]
    joined = df.join(normals.select(*keys, F.col(mean).alias("__m"), F.col(std).alias("__s")), keys, "left")
    z = F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))
    return joined.withColumn("anomaly", z).drop("__m", "__s")


def week_normals(scored: DataFrame, index: str = "overall_stress_index") -> DataFrame:
    """Mean and sample std of an index per county and season week."""
    return scored.groupBy("fips", "week_of_season").agg(
        F.avg(index).alias("index_mean"), F.stddev_samp(index).alias("index_std"))
