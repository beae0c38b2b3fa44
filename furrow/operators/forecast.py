"""Season-to-date features and the linear yield forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.config import FORECAST, UNCERTAINTY_STEPS, ForecastCoefficients
from furrow.functions.scalars import clamp
from furrow.operators.joins import tail_weeks

FEATURES = ("heat_days", "water_deficit", "precip", "ndvi_avg", "ndvi_min", "ndvi_std", "weeks_completed")


def season_to_date(scored: DataFrame, week: int | None = None, limit: int = 30, parity: bool = True) -> DataFrame:
    """One record per county and week number up to the current week, the later date winning.

    Input is the stress record's ``indicators`` over each county's last ``limit``
    weeks. With ``parity`` the heat-day field is the truncated temperature and the
    weeks of two seasons mix, as published; without it the real day counts of the
    weekly table and only the newest season are used.
    """
    tail = tail_weeks(scored, limit)
    if not parity:
        tail = tail.withColumn("__y", F.max("year").over(Window.partitionBy("fips"))).filter(
            F.col("year") == F.col("__y")).drop("__y")
    i = F.col("indicators")
    heat = F.coalesce(i["lst_mean"], F.lit(0.0)).cast("int") if parity else F.col("lst_days_above_32").cast("int")
    rain = i["precipitation_mean"] if parity else F.col("pr_sum")
    record = F.struct(
        F.coalesce(i["water_deficit_mean"], F.lit(0.0)).alias("water_deficit_mean"),
        heat.alias("lst_days_above_32C"),
        F.coalesce(i["ndvi_mean"], F.lit(0.5)).alias("ndvi_mean"),
        F.coalesce(i["vpd_mean"], F.lit(0.0)).alias("vpd_mean"),
        F.coalesce(rain, F.lit(0.0)).alias("pr_sum"), "year")
    rows = (tail.groupBy("fips", F.col("week_of_season").alias("week"))
            .agg(F.max_by(record, "week_start").alias("r"))
            .withColumn("current_week", F.lit(week) if week else
                        F.max("week").over(Window.partitionBy("fips"))))
    return rows.filter(F.col("week") <= F.col("current_week")).select(
        "fips", "current_week", "week", "r.*")


def _features(over: Window | None = None) -> dict[str, Column]:
    def stat(c: Column) -> Column:
        return c if over is None else c.over(over)

    weeks = stat(F.count(F.lit(1)))
    return {
        "heat_days": stat(F.sum("lst_days_above_32C")),
        "water_deficit": stat(F.sum("water_deficit_mean")),
        "precip": stat(F.sum("pr_sum")),
        "ndvi_avg": stat(F.avg("ndvi_mean")),
        "ndvi_min": stat(F.min("ndvi_mean")),
        "ndvi_std": F.when(weeks > 1, stat(F.stddev_pop("ndvi_mean"))).otherwise(0.0),
        "weeks_completed": weeks,
    }


def forecast_features(records: DataFrame, keys: Sequence[str] = ("fips", "current_week")) -> DataFrame:
    """Model features per county from its season-to-date records."""
    return records.groupBy(*keys).agg(*[c.alias(n) for n, c in _features().items()])


def running_features(records: DataFrame, keys: Sequence[str] = ("fips",), last_week: int | None = None) -> DataFrame:
    """The same features for every current week, as running aggregates over the weeks so far.

    With ``last_week`` a week without a record takes the features of the one before.
    """
    series = Window.partitionBy(*keys).orderBy("week")
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    names = {n: c.alias(n) for n, c in _features(so_far).items()}
    if last_week is None:
        return records.select(*keys, F.col("week").alias("current_week"), *names.values())
    upto = F.lead("week").over(series) - 1
    table = records.select(*keys, "week", upto.alias("__upto"), *names.values())
    weeks = F.explode(F.sequence("week", F.coalesce("__upto", F.greatest("week", F.lit(last_week)))))
    return table.select(*keys, weeks.alias("current_week"), *names)


def season_records(weekly: DataFrame) -> DataFrame:
    """Season records of all years from the weekly table, with its real heat-day counts."""
    return weekly.select(
        "fips", "year", F.col("week_of_season").alias("week"),
        F.coalesce("water_deficit_mean", F.lit(0.0)).alias("water_deficit_mean"),
        F.col("lst_days_above_32").alias("lst_days_above_32C"),
        F.coalesce("ndvi_mean", F.lit(0.5)).alias("ndvi_mean"),
        F.coalesce("vpd_mean", F.lit(0.0)).alias("vpd_mean"),
        F.coalesce("pr_sum", F.lit(0.0)).alias("pr_sum"))


def forecast_linear(features: DataFrame, k: ForecastCoefficients = FORECAST) -> DataFrame:
    adjustment = (F.col("heat_days") * k.heat_days + F.col("water_deficit") * k.water_deficit
                  + F.col("precip") * k.precip + F.col("ndvi_avg") * k.ndvi_avg
                  + F.col("ndvi_min") * k.ndvi_min)
    return features.withColumn("stress_adjustment", adjustment).withColumns({
        "baseline_yield": F.lit(k.baseline), "raw_forecast": F.col("stress_adjustment") + k.baseline})


def uncertainty(week: Column, model: str = "linear") -> Column:
    chain = None
    for upper, value in UNCERTAINTY_STEPS[model]:
        if upper is None:
            return chain.otherwise(value)
        cond = week < upper
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain


def confidence(week: Column, light: bool = False) -> Column:
    """The light form knows no "low"."""
    if light:
        return F.when(week < 30, "medium").otherwise("high")
    return F.when(week < 22, "low").when(week < 30, "medium").otherwise("high")


def forecast_driver() -> Column:
    return (F.when(F.col("heat_days") > 10, "Heat stress").when(F.col("water_deficit") > 50, "Water deficit")
            .when(F.col("ndvi_avg") < 0.5, "Vegetation health").otherwise("Normal conditions"))


def with_interval(df: DataFrame, model: str = "linear", week: str = "current_week",
                  raw: str = "raw_forecast", k: ForecastCoefficients = FORECAST) -> DataFrame:
    """Bounded point forecast and its interval; each bound is limited on its outer side only."""
    point, spread = F.col(raw), F.col("forecast_uncertainty")
    return df.withColumn("forecast_uncertainty", uncertainty(F.col(week), model)).withColumns({
        "yield_forecast_bu_acre": clamp(point, k.floor, k.ceiling),
        "confidence_interval_lower": F.greatest(F.lit(k.floor), point - spread),
        "confidence_interval_upper": F.least(F.lit(k.ceiling), point + spread),
    })


def forecast(features: DataFrame, week: str = "current_week") -> DataFrame:
    """Full linear forecast: point, interval, confidence and driver."""
    return with_interval(forecast_linear(features), week=week).withColumns({
        "confidence": confidence(F.col(week)),
        "model_type": F.lit("Linear Regression (fallback)"),
        "primary_driver": F.lit("Mixed stress factors"),
    })


def forecast_response(df: DataFrame, week: str = "current_week") -> DataFrame:
    """Response fields with the defaults for what a model does not deliver."""
    def field(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    return df.select(
        "fips", F.col(week).alias("week"), F.col("yield_forecast_bu_acre").alias("predicted_yield"),
        field("forecast_uncertainty", 0.31).alias("confidence_interval"),
        F.col("confidence_interval_lower").alias("confidence_lower"),
        F.col("confidence_interval_upper").alias("confidence_upper"),
        field("primary_driver", "unknown").alias("primary_driver"),
        field("model_r2", 0.835).alias("model_r2"))


def light_features(df: DataFrame) -> DataFrame:
    """A given feature row with the two placeholders of the light form."""
    return df.withColumns({"ndvi_std": F.lit(0.0), "weeks_completed": F.lit(1).cast("long")})


def forecast_light(df: DataFrame, week: str = "current_week", raw: str = "raw_forecast") -> DataFrame:
    """Light response over a scored feature row: unbounded point, fixed uncertainty."""
    return df.select("fips", F.col(week).alias("week"), F.col(raw).alias("predicted_yield"),
                     F.lit(8.32).alias("uncertainty"), confidence(F.col(week), light=True).alias("confidence"))


def evaluate(df: DataFrame, actual: str, predicted: str, by: str | None = None) -> DataFrame:
    """R squared and mean absolute error, overall and with ``by`` per group as well, in one pass.

    The overall row has no group value. The total sum of squares comes from the
    population variance, so no second pass over the data is needed.
    """
    y, p = F.col(actual), F.col(predicted)
    total = F.var_pop(actual) * F.count(actual)
    r2 = F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), total)
    present = df.filter(y.isNotNull() & p.isNotNull())
    grouped = present.groupBy() if by is None else present.rollup(by)
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), r2.alias("r2"), F.avg(F.abs(y - p)).alias("mae"))
