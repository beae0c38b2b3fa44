"""Joins the built-in equi join does not give directly: as-of, range, nearest week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST_YEAR = 9999


def asof_mask(obs: DataFrame, masks: DataFrame, oldest: int = 2010) -> DataFrame:
    """Newest mask year not after the observation year and not before ``oldest``; else the row goes.

    Each mask year is spread over the years it serves, at most one row per
    calendar year, so the as-of match is an ordinary equi join on the year.
    """
    years = masks.select("mask_year").filter(F.col("mask_year") >= oldest).distinct()
    upto = F.lead("mask_year", 1, LAST_YEAR + 1).over(Window.orderBy("mask_year")) - 1
    serving = years.withColumn("upto", upto).select(
        F.explode(F.sequence("mask_year", "upto")).alias("__year"), "mask_year")
    return obs.withColumn("__year", F.year("date")).join(serving, "__year").drop("__year")


def range_join(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str,
               width: float) -> DataFrame:
    """Left join of points to the intervals [low, high) they fall in.

    Intervals are cut into bins of ``width`` and matched by bin, then by the exact
    bounds; choose a width near the usual interval length.
    """
    bins = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    cut = intervals.withColumn("__bin", bins)
    spots = points.withColumn("__bin", F.floor(F.col(value) / width))
    inside = (F.col(f"p.{value}") >= F.col(f"i.{low}")) & (F.col(f"p.{value}") < F.col(f"i.{high}"))
    return spots.alias("p").join(cut.alias("i"), (F.col("p.__bin") == F.col("i.__bin")) & inside, "left").select(
        *[F.col(f"p.{c}") for c in points.columns],
        *[F.col(f"i.{c}") for c in intervals.columns if c not in points.columns])


def with_county_name(df: DataFrame, counties: DataFrame) -> DataFrame:
    return df.join(counties.select("fips", "county_name"), "fips", "left")


def with_normals(weekly: DataFrame, normals: DataFrame) -> DataFrame:
    """Week rows with the normals of their county and season week."""
    keys = ["fips", "week_of_season"]
    return weekly.join(normals.drop("county_name"), keys, "left")


def training_set(features: DataFrame, yields: DataFrame) -> DataFrame:
    return features.join(yields.select("fips", "year", "yield_bu_per_acre"), ["fips", "year"])


def tail_weeks(df: DataFrame, limit: int = 20, keys: Sequence[str] = ("fips",)) -> DataFrame:
    """Last ``limit`` weeks of every county."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("week_start"))
    return df.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= limit).drop("__rn")


def nearest_week_table(scored: DataFrame, limit: int = 30, same_season: bool = False, weeks: int = 27) -> DataFrame:
    """Row to use for every county and target week, over the county's last ``limit`` weeks.

    The exact week wins, else the smallest distance, the earlier date on ties; the
    target without a week (null) takes the highest week. With ``same_season`` only
    the county's newest season counts. At most 28 rows per county.
    """
    tail = tail_weeks(scored, limit)
    if same_season:
        newest = F.max("year").over(Window.partitionBy("fips"))
        tail = tail.withColumn("__y", newest).filter(F.col("year") == F.col("__y")).drop("__y")
    # only weeks and dates are compared, once per county; the rows themselves are not aggregated per target
    county = Window.partitionBy("fips").orderBy(F.desc("week_start"))
    whole = county.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    targets = F.concat(F.sequence(F.lit(1), F.lit(weeks)), F.array(F.lit(None).cast("int")))

    def nearest(target: Column) -> Column:
        found = F.array_min(F.transform("__weeks", lambda w: F.struct(
            F.when(target.isNull(), -w["week_of_season"]).otherwise(F.abs(w["week_of_season"] - target)).alias("d"),
            w["week_start"].alias("s"), w["__at"].alias("at"))))
        return F.struct(target.alias("week"), found["at"].alias("at"))

    at = tail.withColumn("__at", F.row_number().over(county)).withColumn(
        "__weeks", F.collect_list(F.struct("week_of_season", "week_start", "__at")).over(whole))
    picked = at.withColumn("__picks", F.first(F.when(F.col("__at") == 1, F.transform(targets, nearest))).over(whole))
    served = picked.withColumn("__pick", F.explode(F.filter("__picks", lambda p: p["at"] == F.col("__at"))))
    return served.select("fips", F.col("__pick")["week"].alias("target_week"), *[c for c in tail.columns if c != "fips"])


def target_week(week: Column, weeks: int = 27) -> Column:
    """Requested week inside the season; no week, and week 0, mean the highest one."""
    return F.when(week != 0, F.greatest(F.lit(1), F.least(F.lit(weeks), week)))


def nearest_week(requests: DataFrame, scored: DataFrame, limit: int = 30, same_season: bool = False) -> DataFrame:
    """Requests (fips, week) with the week row they refer to; null columns where the county has none.

    Weeks outside the season are nearest to its first or last week, so the lookup
    by whole weeks is exact and no request is multiplied.
    """
    table = nearest_week_table(scored, limit, same_season)
    wanted = requests.withColumn("__t", F.coalesce(target_week(F.col("week")), F.lit(0)))
    found = table.withColumn("__t", F.coalesce("target_week", F.lit(0))).drop("target_week")
    return wanted.join(found, ["fips", "__t"], "left").drop("__t")


def county_week(requests: DataFrame, weekly: DataFrame, days: int = 7) -> DataFrame:
    """Requests (fips, day) with the first county row whose week starts in [day, day + 6].

    Week rows are listed under each of the 7 days that reach them, so the match is
    an equi join; a request without a row has ``found`` false.
    """
    rest = [c for c in weekly.columns if c != "fips"]
    reach = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda n: F.date_sub("week_start", n)))
    table = (weekly.withColumn("day", reach).groupBy("fips", "day")
             .agg(F.min_by(F.struct(*rest), "week_start").alias("__row")))
    joined = requests.join(table, ["fips", "day"], "left")
    return joined.select(*requests.columns, F.col("__row").isNotNull().alias("found"), "__row.*")


def latest_week(df: DataFrame, keys: Sequence[str] = ("fips", "county_name", "week_of_season")) -> DataFrame:
    """Rows within 6 days of the newest week; per key the first present value of each column."""
    newest = df.agg(F.max("week_start")).scalar()
    recent = df.filter(F.col("week_start") >= F.date_sub(newest, 6))
    rest = [c for c in df.columns if c not in keys]
    return recent.groupBy(*keys).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col("week_start"))).alias(c) for c in rest])
