"""Queries over the data-quality and drift checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import schemas
from furrow.config import INDICATORS, VALUE_RANGES
from furrow.operators import drift, quality
from furrow.plans import domain as d
from furrow.plans.base_sql import ALL, r6
from furrow.plans.ingestion import DAILY_OUT
from furrow.plans.registry import query
from furrow.session import materialise

MEANS = [f"{n}_mean" for n in INDICATORS]


def per_column_sql(columns, body: str, source: str = "daily") -> str:
    """The same aggregate row for every column; ``{c}`` stands for the column."""
    return "\nUNION ALL ".join(
        f'SELECT \'{c}\' AS "column", {body.replace("{c}", c)} FROM {source}' for c in columns)


def _rows(df):
    return df.agg(F.count("*")).scalar()


@query("dq_schema", """
SELECT c AS "column", e AS expected, a AS actual, (SELECT count(*) FROM daily) AS rows
FROM (VALUES ('year', 'bigint', 'int'), ('et_mean', 'double', 'missing')) AS t(c, e, a)""")
def dq_schema(spark, sf):
    expected = T.StructType([
        T.StructField(f.name, T.LongType() if f.name == "year" else f.dataType) for f in schemas.DAILY.fields
    ] + [T.StructField("et_mean", T.DoubleType())])
    daily = d.daily(spark, sf)
    return quality.check_schema(daily, expected).withColumn("rows", _rows(daily))


@query("column_difference", """
SELECT c AS "column", (SELECT count(*) FROM weekly) AS rows FROM (VALUES ('date'), ('et_mean')) AS t(c)""")
def column_difference(spark, sf):
    weekly = d.weekly(spark, sf)
    wanted = ["date", "fips", "county_name", "year", "week_of_season", "et_mean", *MEANS]
    return quality.column_difference(weekly, wanted).withColumn("rows", _rows(weekly))


@query("dq_required", per_column_sql(
    DAILY_OUT, "count(*) AS total, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
               "count(*) FILTER (WHERE {c} IS NULL) > count(*) * 0.05e0 AS critical"))
def dq_required(spark, sf):
    return quality.check_required(d.daily(spark, sf), DAILY_OUT)


TIGHT = {**VALUE_RANGES, "lst_mean": (3.0, 45.0), "eto_mean": (0.5, 12.0), "water_deficit_mean": (-5.0, 12.0)}


@query("dq_range", "\nUNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS out_of_range, count({c}) AS present,
  {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max,
  {r6(f'count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) * 100e0 / nullif(count({c}), 0)')} AS pct FROM daily"""
       for c, (lo, hi) in TIGHT.items()))
def dq_range(spark, sf):
    return quality.check_ranges(d.daily(spark, sf), TIGHT)


@query("dq_iqr", "\nUNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers, count({c}) AS present,
  {r6('any_value(lo)')} AS lower_bound, {r6('any_value(hi)')} AS upper_bound,
  {r6(f'count(*) FILTER (WHERE {c} < lo OR {c} > hi) * 100e0 / nullif(count({c}), 0)')} AS pct
FROM obsd CROSS JOIN (SELECT q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM obsd))""" for c in MEANS))
def dq_iqr(spark, sf):
    return quality.iqr_outliers(materialise(d.observations(spark, sf).select(*MEANS), "obs"), MEANS)


@query("dq_completeness", "m AS (" + per_column_sql(
    DAILY_OUT, "count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS missing") + f""")
--
SELECT "column", rows, missing, CAST(sum(rows) OVER () AS BIGINT) AS total_cells,
  CAST(sum(missing) OVER () AS BIGINT) AS missing_cells,
  {r6('1 - sum(missing) OVER () / CAST(sum(rows) OVER () AS DOUBLE)')} AS completeness,
  1 - sum(missing) OVER () / CAST(sum(rows) OVER () AS DOUBLE) >= 0.95e0 AS is_valid FROM m""")
def dq_completeness(spark, sf):
    return quality.completeness(d.daily(spark, sf))


@query("dq_duplicates", """
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, sum(n - 1) = 0 AS is_valid
FROM (SELECT count(*) AS n FROM px GROUP BY date, fips)""")
def dq_duplicates(spark, sf):
    return quality.duplicates(d.readings(spark, sf))


@query("dq_three_sigma", f"""
SELECT event_id, {r6('value')} AS value FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
WHERE abs(value - m) > 3 * s""")
def dq_three_sigma(spark, sf):
    return quality.sigma_outliers(d.table(spark, sf, "events").select("event_id", "value"), "value")


def z_sql(mean: str) -> str:
    return f"CASE WHEN s > 0 THEN ({mean} - m) / s ELSE 0e0 END"


def _temporal(c: str) -> str:
    return f"""SELECT '{c}' AS "column", r, m, s FROM
  (SELECT avg({c}) AS r FROM (SELECT {c} FROM obsd ORDER BY date DESC, fips DESC LIMIT 7)) CROSS JOIN
  (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM obsd)"""


TEMPORAL = "t AS (" + " UNION ALL ".join(_temporal(c) for c in MEANS) + ")"


@query("drift_temporal", TEMPORAL + f"""
--
SELECT "column", {r6('r')} AS recent_mean, {r6('m')} AS overall_mean, {r6(z_sql('r'))} AS z_score,
  abs({z_sql('r')}) > 2 AS has_drift FROM t""")
def drift_temporal(spark, sf):
    return drift.temporal_drift(materialise(d.observations(spark, sf), "obs"), MEANS)


GROUP = "g AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", fips, mean, n, m, s FROM (SELECT fips, avg({c}) AS mean, count({c}) AS n FROM obsd
  GROUP BY fips) CROSS JOIN (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM obsd)""" for c in MEANS) + ")"


@query("drift_group", GROUP + f"""
--
SELECT fips, "column", {r6('mean')} AS mean, {r6(z_sql('mean'))} AS z_score, n FROM g
WHERE abs({z_sql('mean')}) > 0.15e0""")
def drift_group(spark, sf):
    return drift.group_drift(materialise(d.observations(spark, sf), "obs"), MEANS, threshold=0.15)


MISSING = "x AS (" + per_column_sql(
    DAILY_OUT, "avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) * 100 AS missing_pct") + ")"


@query("drift_missing", MISSING + f"""
--
SELECT "column", {r6('missing_pct')} AS missing_pct FROM x WHERE missing_pct > 10""")
def drift_missing(spark, sf):
    return drift.missing_drift(d.daily(spark, sf))


@query("drift_report", TEMPORAL.replace("obsd", "daily") + ",\n" + GROUP.replace("obsd", "daily") + ",\nx AS (" + per_column_sql(
    MEANS, "avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) * 100 AS missing_pct") + f""")
--
SELECT 'temporal' AS "check", "column", NULL AS fips, {r6('r')} AS mean, {r6(z_sql('r'))} AS z_score,
  NULL::BIGINT AS n, NULL::DOUBLE AS missing_pct, abs({z_sql('r')}) > 2 AS has_drift FROM t
UNION ALL SELECT 'county', "column", fips, {r6('mean')}, {r6(z_sql('mean'))}, n, NULL, true FROM g
  WHERE abs({z_sql('mean')}) > 0.15e0
UNION ALL SELECT 'missing', "column", NULL, NULL, NULL, NULL, {r6('missing_pct')}, true FROM x WHERE missing_pct > 10""")
def drift_report(spark, sf):
    return drift.drift_report(materialise(d.daily(spark, sf), "daily"), MEANS, group_threshold=0.15)


@query("freshness", """
SELECT fips, CAST(max(date) AS VARCHAR) AS newest, (SELECT last_day FROM span) - max(date) AS age_days,
  (SELECT last_day FROM span) - max(date) > 7 AS stale FROM obs GROUP BY fips""")
def freshness(spark, sf):
    return quality.freshness(d.indicator(spark, sf, "lst"), d.season_end(spark, sf), by=("fips",))


FLAGS = ("pr_sum", "lst_max", "ndvi_mean", "eto_mean")


@query("extrapolation_flag", "lim AS (SELECT " + ", ".join(
    f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in FLAGS) + """ FROM weekly WHERE year <= (SELECT year(first_day) + 1 FROM span))
--
SELECT fips, year, week_of_season, array_to_string(list_filter([""" + ", ".join(
    f"CASE WHEN {c} < {c}_lo OR {c} > {c}_hi THEN '{c}' END" for c in FLAGS)
       + """], lambda z: z IS NOT NULL), ',') AS extrapolated FROM weekly CROSS JOIN lim WHERE year > (SELECT year(first_day) + 1 FROM span)""")
def extrapolation_flag(spark, sf):
    weekly, trained = d.weekly(spark, sf), F.col("year") <= d.season_years(spark, sf)[0] + 1
    limits = quality.training_ranges(weekly.filter(trained), FLAGS)
    flagged = quality.out_of_training_range(weekly.filter(~trained), limits, FLAGS)
    return flagged.select("fips", "year", "week_of_season", F.array_join("extrapolated", ",").alias("extrapolated"))
