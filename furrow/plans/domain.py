"""The driver's tables read as the domain's tables.

Every query and every plan below starts here. Line items stand in for pixels,
suppliers for counties; the expressions are stated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.calendar import in_season
from furrow.functions.calendar import season_end as calendar_end
from furrow.operators import grid, joins, rollup, stress
from furrow.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snap(value: Column) -> Column:
    """Nine digits, so that sums in another order give the same stored value."""
    return F.rint(value * 1e9) / 1e9 + 0.0


def snapped(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[snap(F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns])


def county_code(key: Column) -> Column:
    return (key + 19000).cast("string")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels under their county code, without names: nothing is joined at pixel level."""
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), county_code(F.col("l_suppkey")).alias("fips"),
        "l_orderkey", "l_linenumber", "l_suppkey",
        (F.col("l_partkey") % 680 / 100.0 - 96.8).alias("lon"),
        (F.col("l_orderkey") % 330 / 100.0 + 40.2).alias("lat"),
        F.when(F.col("l_returnflag") == "A", 5).otherwise(1).alias("crop_class"),
        (F.col("l_discount") * 10).alias("ndvi"), F.col("l_quantity").alias("lst"),
        (F.col("l_tax") * 50).alias("vpd"), (F.col("l_extendedprice") / 7000.0).alias("eto"),
        (F.greatest(F.lit(0), F.col("l_orderkey") % 40 - 20) / 2.0).alias("pr"))


def county_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County code, name and nation."""
    return table(spark, sf_dir, "supplier").select(
        county_code(F.col("s_suppkey")).alias("fips"), F.col("s_name").alias("county_name"),
        F.col("s_nationkey").alias("nation"))


def season_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_season(readings(spark, sf_dir))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indicators per county and day in one pass over the pixels."""
    return grid.with_deficit(grid.zonal_table(season_readings(spark, sf_dir)))


def indicator(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Observation table of one indicator; names join the aggregated rows."""
    stats = grid.zonal_stats(season_readings(spark, sf_dir), name, keys=("date", "fips"))
    return joins.with_county_name(stats, county_names(spark, sf_dir)).withColumn("mask_year", F.year("date"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation table as the pipeline stores it: the pixels are reduced once per session and input."""
    return stored("observations", [table(spark, sf_dir, "lineitem")], lambda: observations(spark, sf_dir))


def counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counties with observations, with the name of their last one."""
    seen = observed(spark, sf_dir).groupBy("fips").agg(F.max("date").alias("date"))
    return grid.county_dim(joins.with_county_name(seen, county_names(spark, sf_dir)))


def season_years(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    """First and last year with observations, as scalar subqueries over the reduced table."""
    obs = observed(spark, sf_dir)
    return tuple(obs.agg(F.year(f("date"))).scalar() for f in (F.min, F.max))


def season_end(spark: SparkSession, sf_dir: str) -> Column:
    """Last day of the newest season."""
    return calendar_end(season_years(spark, sf_dir)[1])


def season_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.season_grid(counties(spark, sf_dir), *season_years(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The season grid with all observations, made season by season."""
    return grid.daily_by_season(counties(spark, sf_dir), *season_years(spark, sf_dir), observed(spark, sf_dir))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly table as the pipeline stores it; serving queries read it."""
    sources = [table(spark, sf_dir, n) for n in ("lineitem", "supplier")]
    return stored("weekly", sources, lambda: snapped(rollup.weekly_from_observations(
        observed(spark, sf_dir), counties(spark, sf_dir), *season_years(spark, sf_dir))))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stress.score(weekly(spark, sf_dir))


def recent_scores(spark: SparkSession, sf_dir: str, limit: int = 30) -> DataFrame:
    """Stress record of every county's last weeks; only those are scored."""
    return stress.score(joins.tail_weeks(weekly(spark, sf_dir), limit))


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County-year harvests."""
    first, last = season_years(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", first.alias("first"), last.alias("last"))
    year = F.explode(F.sequence("first", "last"))
    return suppliers.select(
        year.alias("year"), county_code(F.col("s_suppkey")).alias("fips"), F.col("s_name").alias("county"),
        "s_suppkey").select(
        "year", "fips", "county",
        (120 + (F.col("s_suppkey") * 37 + F.col("year") * 11) % 100).cast("double").alias("yield_bu_per_acre"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat requests: every user turn, dealt to the counties; some carry values of the client."""
    known = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    conv, turn = F.col("conv_id"), F.col("turn")
    sent = conv % 3 == 0
    return turns.select(
        F.concat_ws("#", conv.cast("string"), turn.cast("string")).alias("request_id"), F.col("text").alias("message"),
        F.when(conv % 11 != 10, county_code(conv % known)).alias("fips"),
        F.when(turn % 4 != 3, ((conv * 7 + turn * 3) % 31).cast("int")).alias("week"),
        (conv % 7 != 6).alias("include_live_data"),
        F.when(sent, (conv % 100).cast("double")).alias("overall_stress"),
        F.when(sent & (turn % 2 == 0), (conv % 90).cast("double")).alias("water_stress"),
        F.lit(None).cast("double").alias("heat_stress"),
        F.lit(None).cast("double").alias("vegetation_health"),
        F.lit(None).cast("double").alias("atmospheric_stress"),
        F.when(sent, (conv % 5 * 40).cast("double")).alias("predicted_yield"),
        F.when(sent, (conv % 4 * 3).cast("double")).alias("yield_uncertainty"))
