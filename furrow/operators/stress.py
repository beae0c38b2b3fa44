"""Stress scoring of the weekly table, all counties and weeks in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.config import (GROWTH_WINDOWS, HEALTH_BANDS, HEALTH_WEIGHTS, STRESS_WEIGHTS, WEEK_HINTS,
                           StressWeights)
from furrow.functions import bands, stress
from furrow.functions.scalars import half_up
from furrow.operators.joins import latest_week

PARTS = ("water", "heat", "vegetation", "atmosphere")

# Name, driver label, description of the sub-indices, in order of declaration.
PART_TEXT = {
    "water": ("Water Stress Index", "Water stress", "Combination of water deficit, precipitation, and ET"),
    "heat": ("Heat Stress Index", "Heat stress", "Based on land surface temperature and atmospheric dryness"),
    "vegetation": ("Vegetation Health Index", "Low vegetation health",
                   "Normalized Difference Vegetation Index (NDVI)"),
    "atmosphere": ("Atmospheric Stress Index", "Atmospheric stress",
                   "Evaporative demand and atmospheric conditions"),
}
PART_COLUMN = {"water": "water_stress_index", "heat": "heat_stress_index",
               "vegetation": "vegetation_health_index", "atmosphere": "atmospheric_stress_index"}

# Indicator name in the response -> weekly column (None: not in the weekly table).
INDICATOR_MAP = {
    "water_deficit_mean": "water_deficit_mean", "precipitation_mean": "pr_mean", "et_mean": None,
    "lst_mean": "lst_mean", "vpd_mean": "vpd_mean", "eto_mean": "eto_mean", "ndvi_mean": "ndvi_mean",
}


def with_indices(df: DataFrame, weights: StressWeights = STRESS_WEIGHTS) -> DataFrame:
    """The four sub-indices and the composite, unrounded."""
    parts = df.withColumns({
        "water": stress.water_index(F.col("water_deficit_mean"), F.col("pr_sum"), F.col("eto_sum"), weights),
        "heat": stress.heat_index(F.col("lst_mean"), F.col("vpd_mean"), weights),
        "vegetation": stress.vegetation_index(F.col("ndvi_mean")),
        "atmosphere": stress.atmospheric_index(F.col("vpd_mean"), F.col("eto_mean"), weights),
    })
    return parts.withColumn("overall", stress.composite_index(*[F.col(p) for p in PARTS], weights))


def key_drivers() -> dict[str, Column]:
    """Text naming what drives each sub-index."""
    return {
        "water": stress.water_driver(F.col("water_deficit_mean"), F.col("pr_sum")),
        "heat": stress.heat_driver(F.col("lst_mean"), F.col("vpd_mean")),
        "vegetation": stress.vegetation_driver(F.col("ndvi_mean")),
        "atmosphere": F.lit("Atmospheric evaporative demand"),
    }


def with_drivers(df: DataFrame) -> DataFrame:
    """First and second of the sub-indices by size; ties keep the order of declaration."""
    ranked = F.array_sort(F.array(*[
        F.struct((-F.col(p)).alias("v"), F.lit(i).alias("i"), F.lit(PART_TEXT[p][1]).alias("name"))
        for i, p in enumerate(PARTS)]))
    return df.withColumn("__ranked", ranked).withColumns({
        "primary_driver": F.col("__ranked")[0]["name"],
        "secondary_driver": F.col("__ranked")[1]["name"],
    }).drop("__ranked")


def indicator_map(df: DataFrame) -> Column:
    """Raw indicators by response name; 0 where the column or the value is missing."""
    entries = []
    for name, column in INDICATOR_MAP.items():
        present = column is not None and column in df.columns
        entries += [F.lit(name), F.coalesce(F.col(column), F.lit(0.0)) if present else F.lit(0.0)]
    return F.create_map(*entries)


def score(df: DataFrame, weights: StressWeights = STRESS_WEIGHTS) -> DataFrame:
    """Stress record per county week: nested sub-indices, drivers, indicators and advice."""
    texts = key_drivers()
    indexed = with_drivers(with_indices(df, weights))

    def part(p: str) -> Column:
        return F.struct(
            F.lit(PART_TEXT[p][0]).alias("name"), half_up(F.col(p)).alias("value"),
            bands.stress_status(F.col(p)).alias("status"), texts[p].alias("key_driver"),
            F.lit(PART_TEXT[p][2]).alias("description")).alias(PART_COLUMN[p])

    return indexed.select(
        "fips", F.coalesce("county_name", F.lit("Unknown")).alias("county_name"), "year", "week_start",
        F.date_add("week_start", 6).alias("week_end"), "week_of_season",
        half_up(F.col("overall")).alias("overall_stress_index"),
        bands.stress_status(F.col("overall")).alias("overall_status"),
        *[part(p) for p in PARTS], "primary_driver", "secondary_driver",
        indicator_map(df).alias("indicators"),
        stress.recommendations(F.col("overall"), F.col("water"), F.col("heat"), F.col("vegetation"),
                               F.col("week_of_season")).alias("farm_recommendations"))


def latest_scores(weekly: DataFrame, weights: StressWeights = STRESS_WEIGHTS) -> DataFrame:
    return score(latest_week(weekly), weights)


def chart_series(scored: DataFrame) -> DataFrame:
    """Flat plot rows: month-day label, week and the five values."""
    return scored.select(
        "fips", "year", F.date_format("week_start", "MM-dd").alias("date"), F.col("week_of_season").alias("week"),
        F.col("overall_stress_index").alias("overall"),
        *[F.col(f"{PART_COLUMN[p]}.value").alias(p) for p in PARTS])


def flat_scores(scored: DataFrame) -> DataFrame:
    """Stress record with the sub-index fields as plain columns."""
    nested = set(PART_COLUMN.values())
    plain = [c for c in scored.columns if c not in nested]
    return scored.select(*plain, *[
        F.col(f"{PART_COLUMN[p]}.{f}").alias(f"{p}_{f}")
        for p in PARTS for f in ("value", "status", "key_driver")])


def with_growth_stage(df: DataFrame, week: str = "week_of_season") -> DataFrame:
    """Dashboard stage hint (sparse) and the growth window of the week."""
    w = F.col(week)
    hint = F.lit(None).cast("string")
    for number, text in WEEK_HINTS.items():
        hint = F.when(w == number, text).otherwise(hint)
    window = F.lit(None).cast("string")
    for first, last, text in GROWTH_WINDOWS:
        window = F.when(w.between(first, last), text).otherwise(window)
    return df.withColumns({"stage_hint": hint, "growth_window": window})


def _banded(value: Column, table: tuple) -> Column:
    """Score read off a band table, linear inside each band and held at its outer ends."""
    chain = F.when(value.isNull(), None)
    for number, (low, high, at_low, at_high) in enumerate(table):
        inside = F.least(F.greatest(value, F.lit(low)), F.lit(high))
        scaled = at_low + (inside - low) / (high - low) * (at_high - at_low)
        chain = chain.otherwise(scaled) if number == len(table) - 1 else chain.when(value < high, scaled)
    return chain


def health_index(df: DataFrame) -> DataFrame:
    """The knowledge base's other score: higher is healthier, weights by growth stage."""
    water = F.col("water_deficit_mean") * 7
    scores = {"ndvi": _banded(F.col("ndvi_mean"), HEALTH_BANDS["ndvi"]),
              "lst": _banded(F.col("lst_mean"), HEALTH_BANDS["lst"]),
              "vpd": _banded(F.col("vpd_mean"), HEALTH_BANDS["vpd"]),
              "water": _banded(water, HEALTH_BANDS["water"])}
    scored = df.withColumns({f"{n}_score": c for n, c in scores.items()})
    total = F.lit(None).cast("double")
    for last, *shares in reversed(HEALTH_WEIGHTS):
        mean = sum((F.col(f"{n}_score") * s for n, s in zip(scores, shares)), F.lit(0.0))
        total = F.when(F.col("week_of_season") <= last, mean).otherwise(total)
    return scored.withColumn("health_index", total)
