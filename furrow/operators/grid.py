"""Season grid, county dimension and the merged daily table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.config import INDICATORS, PIXEL_INDICATORS
from furrow.functions.calendar import season_end, season_start, week_of_season, with_calendar


def county_dim(df: DataFrame, order: str = "date") -> DataFrame:
    """One name per county; the name seen last wins.

    Spellings are counted off first, so the step that picks one only sees a few rows per county.
    """
    spellings = df.groupBy("fips", "county_name").agg(F.max(order).alias("last_seen"))
    return spellings.groupBy("fips").agg(
        F.max_by("county_name", F.struct("last_seen", "county_name")).alias("county_name"))


def with_years(counties: DataFrame, first_year: int | Column, last_year: int | Column) -> DataFrame:
    """One row per county and year; the years may be scalar subqueries."""
    bounds = counties.select("fips", "county_name", F.lit(first_year).alias("lo"), F.lit(last_year).alias("hi"))
    return bounds.select("fips", "county_name", F.explode(F.sequence("lo", "hi")).alias("year"))


def season_grid(counties: DataFrame, first_year: int | Column, last_year: int | Column) -> DataFrame:
    """Every in-season date for every county, generated in place per county row."""
    years = with_years(counties, first_year, last_year)
    days = F.explode(F.sequence(season_start(F.col("year")), season_end(F.col("year"))))
    return with_calendar(years.select("fips", "county_name", days.alias("date"))
    ).select("date", "fips", "county_name", "year", "month", "doy", "week_of_season")


def crop_mask(class_column: str = "crop_class", code: int = 1) -> Column:
    return (F.col(class_column) == code).cast("byte")


def in_bbox(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return df.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def zonal_stats(pixels: DataFrame, indicator: str, keys: Sequence[str] = ("date", "fips", "county_name"),
                code: int = 1) -> DataFrame:
    """Observation table of one indicator: mean, population std, min, max of masked pixels."""
    value = F.col(indicator)
    return pixels.filter(crop_mask(code=code) == 1).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))


def area_stats(pixels: DataFrame, areas: DataFrame, indicator: str, keys: Sequence[str], code: int = 1) -> DataFrame:
    """:func:`zonal_stats` of areas made of counties: pixels are reduced per county before the areas join.

    ``areas`` maps fips to an area. Means and spreads of counties are put together by their moments.
    """
    own = ["fips", *[k for k in keys if k in pixels.columns and k != "fips"]]
    value = F.col(indicator)
    parts = pixels.filter(crop_mask(code=code) == 1).groupBy(*own).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    named = parts.join(areas, "fips")
    total = named.groupBy(*keys).agg(F.try_divide(F.sum(F.col("m") * F.col("n")), F.sum("n")).alias("mean"))
    spread = named.join(total, list(keys)).groupBy(*keys).agg(
        F.first("mean").alias("mean"),
        F.sqrt(F.try_divide(F.sum((F.col("s") + (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))) * F.col("n")), F.sum("n"))).alias("std"),
        F.min("lo").alias("min"), F.max("hi").alias("max"))
    return spread.select(*keys, "mean", "std", "min", "max")


def zonal_table(pixels: DataFrame, indicators: Sequence[str] = PIXEL_INDICATORS,
                keys: Sequence[str] = ("date", "fips"), code: int = 1) -> DataFrame:
    """Mean and population std of several indicators in one pass over the pixels.

    Partitioned by date and county like the grid, so the merge shuffles only the grid.
    """
    stats = []
    for name in indicators:
        stats += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    return pixels.filter(crop_mask(code=code) == 1).groupBy(*keys).agg(*stats)


def with_deficit(df: DataFrame) -> DataFrame:
    """Deficit columns of a wide table: demand minus rain, with a std of 0 where it exists."""
    deficit = F.col("eto_mean") - F.col("pr_mean")
    return df.withColumn("water_deficit_mean", deficit).withColumn(
        "water_deficit_std", F.when(deficit.isNotNull(), 0.0))


def water_deficit(eto: DataFrame, pr: DataFrame, null_keys: bool = False) -> DataFrame:
    """Demand minus rain per county and day; with ``null_keys`` missing keys match each other."""
    e, p = eto.alias("e"), pr.alias("p")
    keys = [F.col(f"e.{k}").eqNullSafe(F.col(f"p.{k}")) if null_keys
            else F.col(f"e.{k}") == F.col(f"p.{k}") for k in ("date", "fips")]
    mask = [F.col("e.mask_year")] if "mask_year" in eto.columns else []
    return e.join(p, keys, "inner").select(
        "e.date", "e.fips", "e.county_name",
        F.col("e.mean").alias("eto_mean"), F.col("p.mean").alias("pr_mean"),
        (F.col("e.mean") - F.col("p.mean")).alias("water_deficit"),
        F.col("e.std").alias("eto_std"), F.col("p.std").alias("pr_std"), *mask)


def prefixed(df: DataFrame, name: str) -> DataFrame:
    """Keys with the indicator's mean and std under its name."""
    return df.select("date", "fips", F.col("mean").alias(f"{name}_mean"), F.col("std").alias(f"{name}_std"))


def daily_clean(grid: DataFrame, observations: Mapping[str, DataFrame], deficit: DataFrame) -> DataFrame:
    """Grid with all indicators. Observation keys must be unique, as the upsert leaves them.

    The tables go into one long union and a single aggregate by key, so there is
    one join with the grid instead of six in a row.
    """
    long = None
    for name, df in observations.items():
        part = df.select("date", "fips", F.lit(name).alias("name"), "mean", "std")
        long = part if long is None else long.unionByName(part)
    part = deficit.select("date", "fips", F.lit("water_deficit").alias("name"),
                          F.col("water_deficit").alias("mean"), F.lit(0.0).alias("std"))
    long = part if long is None else long.unionByName(part)
    wide = long.groupBy("date", "fips").agg(*[
        F.max(F.when(F.col("name") == name, F.col(stat))).alias(f"{name}_{stat}")
        for name in [*observations, "water_deficit"] for stat in ("mean", "std")])
    return grid.join(wide, ["date", "fips"], "left").select(
        *grid.columns, *[c for c in wide.columns if c not in ("date", "fips")])


def daily_from_wide(grid: DataFrame, wide: DataFrame) -> DataFrame:
    """Grid with the columns of a one-pass wide observation table."""
    values = [f"{name}_{stat}" for name in INDICATORS for stat in ("mean", "std")]
    return grid.join(wide.select("date", "fips", *values), ["date", "fips"], "left").select(
        *grid.columns, *values)


def daily_by_season(counties: DataFrame, first_year: int | Column, last_year: int | Column, wide: DataFrame) -> DataFrame:
    """The rows of :func:`daily_from_wide` over :func:`season_grid`, joined by county season before the days are made.

    Only the observations and a row per county season are shuffled; a season's days, at most 184, are made from its row
    where it lies, so no task sorts or holds the grid. The result stays dealt by county and year. Observations outside the
    season are left out and repeated ones stay, as in the join by day.
    """
    values = [f"{name}_{stat}" for name in INDICATORS for stat in ("mean", "std")]
    day, year = F.col("date"), F.col("year")
    seen = wide.select("date", "fips", F.year(day).alias("year"), *values).filter(day.between(season_start(year), season_end(year)))
    seen = seen.groupBy("fips", "year").agg(F.collect_list(F.struct("date", *values)).alias("seen"))
    seasons = with_years(counties, first_year, last_year).join(seen, ["fips", "year"], "left")
    kind = seen.schema["seen"].dataType.simpleString()
    seasons = seasons.withColumn("seen", F.coalesce("seen", F.array().cast(kind)))
    open_days = F.array_except(F.sequence(season_start(year), season_end(year)), F.transform("seen", lambda d: d["date"]))
    nulls = [F.lit(None).cast(wide.schema[v].dataType).alias(v) for v in values]
    missing = F.transform(open_days, lambda d: F.struct(d.alias("date"), *nulls))
    days = seasons.select("fips", "county_name", "year", F.inline(F.concat("seen", missing)))
    return days.select("date", "fips", "county_name", "year", F.month(day).alias("month"), F.dayofyear(day).alias("doy"),
                       week_of_season(day).alias("week_of_season"), *values)
