"""Queries over the forecast: features, linear and tree models, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.config import TreeGrid
from furrow.operators import explain, forecast, joins, model
from furrow.plans import domain as d
from furrow.plans.base_sql import r6, r6s
from furrow.plans.registry import query
from furrow.session import versions

# Season-to-date records over each county's last 30 weeks, the later date winning per week number.
STD = """
tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fips ORDER BY week_start DESC) AS rn FROM scored)
  WHERE rn <= 30),
std AS (SELECT fips, week_of_season AS week, max_by(i_deficit, week_start) AS water_deficit_mean,
  CAST(trunc(max_by(i_lst, week_start)) AS BIGINT) AS lst_days, max_by(i_ndvi, week_start) AS ndvi_mean,
  max_by(i_vpd, week_start) AS vpd_mean, max_by(i_pr, week_start) AS pr_sum, max_by(year, week_start) AS year
  FROM tail GROUP BY fips, week_of_season),
cur AS (SELECT fips, max(week) AS current_week FROM std GROUP BY fips)"""


def features_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys}, CAST(sum(lst_days) AS BIGINT) AS heat_days, sum(water_deficit_mean) AS water_deficit,
  sum(pr_sum) AS precip, avg(ndvi_mean) AS ndvi_avg, min(ndvi_mean) AS ndvi_min,
  CASE WHEN count(*) > 1 THEN stddev_pop(ndvi_mean) ELSE 0e0 END AS ndvi_std, count(*) AS weeks_completed
  FROM {source} GROUP BY {keys}"""


# Features for every current week: each record counts for its own and all later weeks.
RUN = STD + f""",
seen AS (SELECT s.*, c.week AS current_week FROM std s JOIN std c ON s.fips = c.fips AND s.week <= c.week),
feat AS ({features_sql('fips, current_week', 'seen')})"""

POINT = ("198.7e0 + (heat_days * -1.2e0 + water_deficit * -0.8e0 + precip * 0.15e0 + ndvi_avg * 45e0 + ndvi_min * -15e0)")
FEATURES_OUT = r6s("water_deficit", "precip", "ndvi_avg", "ndvi_min", "ndvi_std")


def unc_sql(a: float, b: float, c: float, e: float) -> str:
    return (f"CASE WHEN current_week < 22 THEN {a}e0 WHEN current_week < 30 THEN {b}e0 "
            f"WHEN current_week < 36 THEN {c}e0 ELSE {e}e0 END")


LINEAR_UNC = unc_sql(15.0, 12.0, 8.32, 5.0)
CONFIDENCE = "CASE WHEN current_week < 22 THEN 'low' WHEN current_week < 30 THEN 'medium' ELSE 'high' END"
FC = RUN + f",\nfc AS (SELECT *, {POINT} AS raw, {LINEAR_UNC} AS u FROM feat)"


def running(spark, sf):
    return forecast.running_features(forecast.season_to_date(d.recent_scores(spark, sf)))


@query("season_to_date", STD + f"""
--
SELECT s.fips, c.current_week, s.week, {r6('water_deficit_mean')} AS water_deficit_mean,
  lst_days AS "lst_days_above_32C", {r6s('ndvi_mean', 'vpd_mean', 'pr_sum')}, s.year FROM std s JOIN cur c ON s.fips = c.fips""")
def season_to_date(spark, sf):
    return forecast.season_to_date(d.recent_scores(spark, sf))


@query("forecast_features", STD + f""",
f AS ({features_sql('fips, current_week', '(SELECT s.*, 20 AS current_week FROM std s WHERE week <= 20)')})
--
SELECT fips, current_week, heat_days, {FEATURES_OUT}, weeks_completed FROM f""")
def forecast_features(spark, sf):
    return forecast.forecast_features(forecast.season_to_date(d.recent_scores(spark, sf), week=20))


@query("forecast_linear", FC + f"""
--
SELECT fips, current_week, heat_days, {FEATURES_OUT}, weeks_completed, {r6('raw - 198.7e0')} AS stress_adjustment,
  198.7e0 AS baseline_yield, {r6('raw')} AS raw_forecast FROM fc""")
def forecast_linear(spark, sf):
    return forecast.forecast_linear(running(spark, sf))


@query("forecast_uncertainty", RUN + f"""
--
SELECT fips, current_week + 14 AS current_week, {LINEAR_UNC.replace('current_week', '(current_week + 14)')} AS linear,
  {unc_sql(12.0, 8.0, 6.5, 4.0).replace('current_week', '(current_week + 14)')} AS tree FROM feat""")
def forecast_uncertainty(spark, sf):
    """Season weeks moved to the calendar-like scale of the published steps."""
    weeks = running(spark, sf).select("fips", (F.col("current_week") + 14).alias("current_week"))
    return weeks.withColumns({m: forecast.uncertainty(F.col("current_week"), m) for m in ("linear", "tree")})


INTERVAL = (f"{r6('greatest(50e0, least(300e0, raw))')} AS yield_forecast_bu_acre, "
            f"{r6('greatest(50e0, raw - u)')} AS confidence_interval_lower, "
            f"{r6('least(300e0, raw + u)')} AS confidence_interval_upper")


@query("forecast_interval", FC + f"\n--\nSELECT fips, current_week, u AS forecast_uncertainty, {INTERVAL} FROM fc")
def forecast_interval(spark, sf):
    return forecast.with_interval(forecast.forecast_linear(running(spark, sf))).select(
        "fips", "current_week", "forecast_uncertainty", "yield_forecast_bu_acre", "confidence_interval_lower",
        "confidence_interval_upper")


@query("forecast_confidence", RUN + f"""
--
SELECT fips, current_week + 14 AS current_week, {CONFIDENCE.replace('current_week', '(current_week + 14)')} AS confidence,
  CASE WHEN current_week + 14 < 30 THEN 'medium' ELSE 'high' END AS light FROM feat""")
def forecast_confidence(spark, sf):
    weeks = running(spark, sf).select("fips", (F.col("current_week") + 14).alias("current_week"))
    week = F.col("current_week")
    return weeks.withColumns({"confidence": forecast.confidence(week), "light": forecast.confidence(week, light=True)})


@query("forecast_driver", RUN + """
--
SELECT fips, current_week, CASE WHEN heat_days > 10 THEN 'Heat stress' WHEN water_deficit > 50 THEN 'Water deficit'
  WHEN ndvi_avg < 0.5e0 THEN 'Vegetation health' ELSE 'Normal conditions' END AS primary_driver FROM feat""")
def forecast_driver(spark, sf):
    return running(spark, sf).select("fips", "current_week", forecast.forecast_driver().alias("primary_driver"))


@query("forecast_response", FC + f"""
--
SELECT fips, current_week AS week, {r6('greatest(50e0, least(300e0, raw))')} AS predicted_yield, u AS confidence_interval,
  {r6('greatest(50e0, raw - u)')} AS confidence_lower, {r6('least(300e0, raw + u)')} AS confidence_upper,
  'Mixed stress factors' AS primary_driver, 0.835e0 AS model_r2 FROM fc""")
def forecast_response(spark, sf):
    return forecast.forecast_response(forecast.forecast(running(spark, sf)))


@query("forecast_light", FC + f"""
--
SELECT fips, current_week AS week, {r6('raw')} AS predicted_yield, 8.32e0 AS uncertainty,
  CASE WHEN current_week < 30 THEN 'medium' ELSE 'high' END AS confidence FROM fc""")
def forecast_light(spark, sf):
    return forecast.forecast_light(model.score_model(forecast.light_features(running(spark, sf)), None))


# ---- trees: seasons of all years, the last one held back for scoring


def season_features(spark, sf):
    return forecast.running_features(forecast.season_records(d.weekly(spark, sf)), keys=("fips", "year"))


def _training(spark, sf):
    """End-of-season features with the harvest."""
    ends = season_features(spark, sf).filter(F.col("current_week") == 27)
    return joins.training_set(ends, d.yields(spark, sf))


_fitted: dict[tuple, tuple] = {}


def _trained(spark, sf):
    """Model and fold scores over the whole grid, fitted once per session and version of the input files."""
    tables = [d.table(spark, sf, n) for n in ("lineitem", "supplier")]
    key = (spark.sparkContext.applicationId, sf, versions(tables))
    if key not in _fitted:
        past = _training(spark, sf).filter(F.col("year") < d.season_years(spark, sf)[1])
        _fitted[key] = model.train(past, TreeGrid(), folds=2)
    return _fitted[key]


@query("model_train")
def model_train(spark, sf):
    return _trained(spark, sf)[1]


@query("feature_importance")
def feature_importance(spark, sf):
    return model.importances(_trained(spark, sf)[0], spark)


def _explained(spark, sf):
    """Contributions for every week of the newest season."""
    features = season_features(spark, sf).filter(F.col("year") == d.season_years(spark, sf)[1])
    return explain.contributions(features, _trained(spark, sf)[0], ("fips", "year", "current_week"))


@query("forecast_explain")
def forecast_explain(spark, sf):
    """What each feature adds to the tree forecast of every county week, strongest first."""
    return explain.drivers(_explained(spark, sf), ("fips", "year", "current_week"))


@query("explained_importance")
def explained_importance(spark, sf):
    """Features by the mean size of what they add to the newest season's forecasts."""
    return explain.importance(_explained(spark, sf))


@query("model_score")
def model_score(spark, sf):
    features = season_features(spark, sf).filter(F.col("year") == d.season_years(spark, sf)[1])
    scored = model.score_model(features, _trained(spark, sf)[0])
    return forecast.with_interval(scored, "tree").select(
        "fips", "year", "current_week", "yield_forecast_bu_acre", "confidence_interval_lower",
        "confidence_interval_upper", "model_type")


@query("model_eval", f"""
rec AS (SELECT fips, year, week_of_season AS week, coalesce(water_deficit_mean, 0e0) AS water_deficit_mean,
  lst_days_above_32 AS lst_days, coalesce(ndvi_mean, 0.5e0) AS ndvi_mean, coalesce(pr_sum, 0e0) AS pr_sum FROM weekly),
seen AS (SELECT r.*, c.week AS current_week FROM rec r JOIN rec c ON r.fips = c.fips AND r.year = c.year AND r.week <= c.week),
feat AS ({features_sql('fips, year, current_week', 'seen')}),
j AS (SELECT f.current_week, y.yield_bu_per_acre AS y, {POINT} AS p FROM feat f JOIN yields y
  ON f.fips = y.fips AND f.year = y.year)
--
SELECT current_week, count(*) AS n, {r6('1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0e0)')} AS r2,
  {r6('avg(abs(y - p))')} AS mae FROM j GROUP BY GROUPING SETS ((current_week), ())""")
def model_eval(spark, sf):
    """Linear forecast against the harvest by season week, and overall in the row without a week."""
    predicted = joins.training_set(forecast.forecast_linear(season_features(spark, sf)), d.yields(spark, sf))
    return forecast.evaluate(predicted, model.LABEL, "raw_forecast", by="current_week")
