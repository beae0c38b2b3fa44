"""Weekly, climatology and summary aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.config import INDICATORS, SEASON
from furrow.functions import bands
from furrow.functions.calendar import week_start, with_calendar
from furrow.functions.scalars import half_up, suffix_cols
from furrow.operators.grid import with_years
from furrow.operators.quantiles import grouped_quantiles

WEEK_KEYS = ("year", "week_of_season", "fips", "county_name")


def _week_stats(df: DataFrame, totals: bool) -> list[Column]:
    stats = [F.avg(c).alias(c) for c in suffix_cols(df, "_mean")]
    stats += [F.sqrt(F.avg(F.col(c) * F.col(c))).alias(c) for c in suffix_cols(df, "_std")]
    if totals:
        stats += [
            F.sum("pr_mean").alias("pr_sum"), F.sum("eto_mean").alias("eto_sum"),
            F.sum("water_deficit_mean").alias("water_deficit_sum"),
            F.min("ndvi_mean").alias("ndvi_min"), F.max("ndvi_mean").alias("ndvi_max"),
            F.max("lst_mean").alias("lst_max"), F.max("vpd_mean").alias("vpd_max"),
            F.count_if(F.col("lst_mean") > 32).alias("lst_days_above_32"),
        ]
    return stats


def _week_table(table: DataFrame) -> DataFrame:
    values = [c for c in table.columns if c not in WEEK_KEYS]
    ordered = [f"{n}_{s}" for n in INDICATORS for s in ("mean", "std") if f"{n}_{s}" in values]
    return table.withColumn("week_start", week_start(F.col("year"), F.col("week_of_season"))).select(
        "week_start", *WEEK_KEYS, *ordered, *[c for c in values if c not in ordered])


def weekly(daily: DataFrame, totals: bool = True) -> DataFrame:
    """County weeks: mean of the means, root mean square of the stds, and the weekly totals."""
    return _week_table(daily.dropna(subset=list(WEEK_KEYS)).groupBy(*WEEK_KEYS).agg(*_week_stats(daily, totals)))


def weekly_from_observations(obs: DataFrame, counties: DataFrame, first_year: int | Column,
                             last_year: int | Column) -> DataFrame:
    """The weekly table of an unfilled daily grid, without building the grid.

    Days without observations add nothing to a week, so the observations are
    rolled up first and completed to all weeks afterwards: the merge handles week
    rows, a seventh of the days.
    """
    keys = ["fips", "year", "week_of_season"]
    rolled = with_calendar(obs).groupBy(*keys).agg(*_week_stats(obs, totals=True))
    weeks = F.explode(F.sequence(F.lit(1), F.lit(SEASON.weeks)))
    all_weeks = with_years(counties.dropna(), first_year, last_year).select("*", weeks.alias("week_of_season"))
    table = all_weeks.join(rolled, keys, "left")
    return _week_table(table.fillna(0, subset=["lst_days_above_32"]))


def climatology(daily: DataFrame) -> DataFrame:
    """Normals per season week and county over all days and years, with sample std."""
    stats = [f(f"{n}_mean").alias(f"{n}_mean_{label}") for n in INDICATORS
             for f, label in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    keys = ["week_of_season", "fips", "county_name"]
    return daily.dropna(subset=keys).groupBy(*keys).agg(*stats)


def run_metadata(daily: DataFrame, weekly_rows: Column | None = None) -> DataFrame:
    """One row of counts, date range and completeness; week rows are the distinct week keys."""
    def share(cond: Column) -> Column:
        return F.avg(F.when(cond, 1.0).otherwise(0.0))

    completeness = F.struct(*[
        share({"pr": F.col("pr_mean") >= 0, "water_deficit": F.col("water_deficit_mean") != 0}.get(
            n, F.col(f"{n}_mean") > 0)).alias(n) for n in INDICATORS])
    weeks = F.countDistinct(*WEEK_KEYS) if weekly_rows is None else weekly_rows
    return daily.agg(
        F.count("*").alias("daily_records"), weeks.alias("weekly_records"),
        F.countDistinct("fips").alias("counties"),
        F.min("date").alias("date_range_start"), F.max("date").alias("date_range_end"),
        completeness.alias("data_completeness"),
    ).withColumns({
        "pipeline_run_date": F.current_timestamp(),
        "indicators": F.array(*[F.lit(n) for n in INDICATORS]),
    })


def nonzero_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of rows above zero per column, one row per column."""
    one = df.agg(*[(F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0)) * 100).alias(c) for c in columns])
    return one.unpivot([], list(columns), "indicator", "nonzero_pct")


def deficit_histogram(df: DataFrame, column: str = "water_deficit") -> DataFrame:
    """Counts and shares of the five deficit bands with the overall mean."""
    names = ("surplus", "normal", "moderate", "high", "severe")
    band = bands.deficit_band(F.col(column))
    one = df.agg(F.count("*").alias("total"), F.avg(column).alias("mean_deficit"),
                 *[F.count_if(band == n).alias(n) for n in names])
    return one.unpivot(["total", "mean_deficit"], list(names), "band", "n").withColumn(
        "pct", F.try_divide(F.col("n") * 100.0, F.col("total")))


def rain_day_stats(df: DataFrame, column: str = "pr_mean") -> DataFrame:
    mm = F.col(column)
    one = df.agg(F.count(mm).alias("days"), F.count_if(mm == 0).alias("dry_days"),
                 F.count_if(mm > 0).alias("wet_days"), F.count_if(mm > 25).alias("heavy_days"))
    return one.withColumns({
        name.replace("days", "pct"): F.try_divide(F.col(name) * 100.0, F.col("days"))
        for name in ("dry_days", "wet_days", "heavy_days")})


def yield_stats(df: DataFrame) -> DataFrame:
    """Yield extremes, mean and counties by year, and overall in the row without a year."""
    bushels = F.col("yield_bu_per_acre")
    stats = [F.count("*").alias("records"), F.min(bushels).alias("min_yield"),
             F.max(bushels).alias("max_yield"), F.avg(bushels).alias("mean_yield"),
             F.countDistinct("fips").alias("counties")]
    by_year = df.groupBy("year").agg(*stats)
    overall = df.agg(*stats).select(F.lit(None).cast("int").alias("year"), "*")
    return by_year.unionByName(overall)


def critical_period(daily: DataFrame, first_doy: int = 196, last_doy: int = 227, hot: float = 35.0) -> DataFrame:
    """Deficit summed over the pollination days, and hot days of the season."""
    window = F.col("doy").between(first_doy, last_doy)
    return daily.groupBy("fips", "year").agg(
        F.sum(F.when(window, F.col("water_deficit_mean"))).alias("critical_deficit"),
        F.count_if(F.col("lst_mean") > hot).alias("heat_days"))


def deficit_accumulation(daily: DataFrame) -> DataFrame:
    return daily.groupBy("fips", "year").agg(
        F.sum("water_deficit_mean").alias("total_deficit"), F.avg("water_deficit_mean").alias("mean_deficit"))


def growing_degree_days(tmax: Column, tmin: Column, base: float = 10.0, cap: float | None = None) -> Column:
    """(tmax + tmin) / 2 - base, with temperatures capped first and a floor of 0."""
    if cap is not None:
        tmax, tmin = F.least(tmax, F.lit(cap)), F.least(tmin, F.lit(cap))
    return F.greatest((tmax + tmin) / 2 - base, F.lit(0.0))


def index_yield_r2(scored: DataFrame, yields: DataFrame, index: str = "overall_stress_index",
                   periods: Sequence[tuple[str, int, int]] = (
                       ("pollination", 10, 12), ("early grain fill", 13, 16), ("season", 1, 27))) -> DataFrame:
    """Squared correlation of the period mean of an index with the harvest, one row per period."""
    week = F.col("week_of_season")
    means = scored.groupBy("fips", "year").agg(
        *[F.avg(F.when(week.between(lo, hi), F.col(index))).alias(name) for name, lo, hi in periods])
    joined = means.join(yields.select("fips", "year", "yield_bu_per_acre"), ["fips", "year"])
    one = joined.agg(*[F.pow(F.corr(name, "yield_bu_per_acre"), 2).alias(name) for name, _, _ in periods])
    return one.unpivot([], [name for name, _, _ in periods], "period", "r2")


def index_distribution(scored: DataFrame, index: str = "overall_stress_index",
                       by: Sequence[str] = ("week_start",)) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.count(index).alias("n"), F.avg(index).alias("mean"), F.stddev_samp(index).alias("std"),
        F.min(index).alias("min"), F.max(index).alias("max"))


def latency_stats(logs: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Latency percentiles, mean sources and success share per request kind.

    The percentiles are exact and found by narrowing, so no task holds the readings of a kind. ``logs`` is read
    several times: pass a written table.
    """
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    quantiles = grouped_quantiles(logs, [latency], list(probs.values()), group="kind")
    kind = logs.schema["kind"].dataType.simpleString()
    table = logs.sparkSession.createDataFrame(
        [(g, *q) for (g, _), q in quantiles.items()], f"__kind {kind}, " + ", ".join(f"{n} double" for n in probs))
    stats = logs.groupBy("kind").agg(
        F.count("*").alias("requests"), F.avg("sources").alias("mean_sources"),
        F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0)).alias("success_share"))
    return stats.join(F.broadcast(table), F.col("kind").eqNullSafe(F.col("__kind")), "left").select(
        "kind", "requests", *probs, "mean_sources", "success_share")


def state_summary(week_scores: DataFrame, k: int = 5) -> DataFrame:
    """One row per week: counties, index statistics and the k most and least stressed counties.

    Works on the county rows of a week; only the ranked k rows are gathered into lists.
    """
    index = F.col("overall_stress_index")
    stats = week_scores.groupBy("week_start").agg(
        F.count("*").alias("counties_analyzed"),
        *[half_up(f(index)).alias(f"{name}_stress_index") for f, name in
          ((F.avg, "average"), (F.max, "max"), (F.min, "min"), (F.stddev_pop, "std"))])
    for name, order in (("critical_counties", index.desc()), ("healthy_counties", index.asc())):
        stats = stats.join(_ranked_lists(week_scores, name, order, k), "week_start", "left")
    return stats


def _ranked_lists(df: DataFrame, name: str, order: Column, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("week_start").orderBy(order, "fips"))
    entry = F.struct("rank", "fips", "county_name", F.col("overall_stress_index").alias("stress_index"),
                     F.col("overall_status").alias("status"))
    return (df.withColumn("rank", rank).filter(F.col("rank") <= k)
            .groupBy("week_start").agg(F.array_sort(F.collect_list(entry)).alias(name)))


def top_k(df: DataFrame, column: str, k: int = 5, descending: bool = True) -> DataFrame:
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(order, "fips").limit(k)


def collection_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count("*").alias("chunks"))
