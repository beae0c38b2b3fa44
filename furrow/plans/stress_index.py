"""Queries over the stress index."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.config import GROWTH_WINDOWS, HEALTH_BANDS, HEALTH_WEIGHTS, WEEK_HINTS
from furrow.functions import bands
from furrow.operators import joins, rollup, stress
from furrow.plans import domain as d
from furrow.plans.base_sql import r6, r6s, status
from furrow.plans.registry import query
from furrow.session import materialise

KEYS = ("fips", "year", "week_of_season")
KEY_SQL = "fips, year, week_of_season"


def _index(name: str, part: str):
    @query(name, f"SELECT {KEY_SQL}, {r6s(part)}, {status(part)} AS status FROM allidx")
    def build(spark, sf):
        return stress.with_indices(d.weekly(spark, sf)).select(
            *KEYS, part, bands.stress_status(F.col(part)).alias("status"))

    return build


for _name, _part in (("water_stress", "water"), ("heat_stress", "heat"), ("vegetation_stress", "vegetation"),
                     ("atmospheric_stress", "atmosphere"), ("composite_stress", "overall")):
    _index(_name, _part)


@query("stress_status", f"SELECT {KEY_SQL}, overall_status FROM scored")
def stress_status(spark, sf):
    return stress.with_indices(d.weekly(spark, sf)).select(
        *KEYS, bands.stress_status(F.col("overall")).alias("overall_status"))


@query("stress_label4", f"""
SELECT {KEY_SQL}, CASE WHEN ndvi_mean IS NULL THEN 'N/A' WHEN overall < 20 THEN 'Healthy' WHEN overall < 40
  THEN 'Mild Stress' WHEN overall < 60 THEN 'Moderate Stress' ELSE 'Severe Stress' END AS label FROM allidx""")
def stress_label4(spark, sf):
    shown = F.when(F.col("ndvi_mean").isNotNull(), F.col("overall"))
    return stress.with_indices(d.weekly(spark, sf)).select(*KEYS, bands.stress_label4(shown).alias("label"))


@query("key_driver", f"""
SELECT {KEY_SQL}, water_key_driver AS water, heat_key_driver AS heat, vegetation_key_driver AS vegetation,
  atmosphere_key_driver AS atmosphere FROM scored""")
def key_driver(spark, sf):
    return d.weekly(spark, sf).select(*KEYS, *[c.alias(n) for n, c in stress.key_drivers().items()])


ADVICE = """
CASE WHEN len(g) = 0 THEN '✅ Conditions are favorable - continue standard management'
  ELSE array_to_string(g, ' | ') END"""

ADVICE_LIST = """
list_filter([
  CASE WHEN water > 70 THEN '🚨 CRITICAL: Implement emergency irrigation if available'
       WHEN water > 50 THEN '⚠️  Monitor soil moisture closely - irrigation recommended' END,
  CASE WHEN water > 70 THEN 'Consider harvesting early if grain fill advanced'
       WHEN water > 50 THEN 'Apply water management practices' END,
  CASE WHEN heat > 70 THEN CASE WHEN week_of_season BETWEEN 8 AND 10
         THEN '🌡️  CRITICAL PERIOD: High heat during pollination - monitor pollen viability' END
       WHEN heat > 50 THEN '⚠️  High temperatures - ensure adequate water availability' END,
  CASE WHEN vegetation > 60 THEN 'Investigate vegetation stress - check for pests/disease'
       WHEN vegetation > 40 THEN 'Monitor for signs of pest or disease pressure' END,
  CASE WHEN vegetation > 60 THEN 'Consider nutrient status evaluation' END,
  CASE WHEN overall > 70 THEN '⚠️  HIGH OVERALL STRESS: Consider crop insurance claim documentation' END
], lambda x: x IS NOT NULL)"""

ADVISED = f"""
advised AS (SELECT *, {ADVICE} AS farm_recommendations FROM (SELECT *, {ADVICE_LIST} AS g FROM scored))"""

RANKED = """
ranked AS (SELECT *, list_transform(list_sort([{'v': -water, 'i': 0, 'n': 'Water stress'},
  {'v': -heat, 'i': 1, 'n': 'Heat stress'}, {'v': -vegetation, 'i': 2, 'n': 'Low vegetation health'},
  {'v': -atmosphere, 'i': 3, 'n': 'Atmospheric stress'}]), lambda x: x.n) AS names FROM advised)"""


@query("recommendations", ADVISED + f"\n--\nSELECT {KEY_SQL}, farm_recommendations FROM advised")
def recommendations(spark, sf):
    return d.scored(spark, sf).select(
        *KEYS, F.array_join("farm_recommendations", " | ").alias("farm_recommendations"))


@query("driver_rank", ADVISED + "," + RANKED + f"""
--
SELECT {KEY_SQL}, names[1] AS primary_driver, names[2] AS secondary_driver FROM ranked""")
def driver_rank(spark, sf):
    return stress.with_drivers(stress.with_indices(d.weekly(spark, sf))).select(
        *KEYS, "primary_driver", "secondary_driver")


IND_SQL = (f"{r6('i_deficit')} AS water_deficit_mean, {r6('i_pr')} AS precipitation_mean, 0e0 AS et_mean, "
           f"{r6('i_lst')} AS lst_mean, {r6('i_vpd')} AS vpd_mean, {r6('i_eto')} AS eto_mean, {r6('i_ndvi')} AS ndvi_mean")


def _indicator_columns():
    return [F.col("indicators")[n].alias(n) for n in stress.INDICATOR_MAP]


@query("indicator_map", f"SELECT {KEY_SQL}, {IND_SQL} FROM scored")
def indicator_map(spark, sf):
    weekly = d.weekly(spark, sf)
    return weekly.select(*KEYS, stress.indicator_map(weekly).alias("indicators")).select(*KEYS, *_indicator_columns())


RECORD_SQL = ("SELECT fips, county_name, year, CAST(week_start AS VARCHAR) AS week_start, CAST(week_end AS VARCHAR) AS week_end, "
              "week_of_season, overall_stress_index, overall_status, "
              + ", ".join(f"{p}_{f}" for p in stress.PARTS for f in ("value", "status", "key_driver"))
              + f", names[1] AS primary_driver, names[2] AS secondary_driver, {IND_SQL}, farm_recommendations FROM ranked")


def _flat(scored):
    flat = stress.flat_scores(scored).withColumn("farm_recommendations", F.array_join("farm_recommendations", " | "))
    return flat.select(*[c for c in flat.columns if c != "indicators"], *_indicator_columns())


@query("score_week", ADVISED + "," + RANKED + "\n--\n" + RECORD_SQL)
def score_week(spark, sf):
    return _flat(d.scored(spark, sf))


@query("latest_all", ADVISED + "," + RANKED + "\n--\n" + RECORD_SQL
       + " WHERE week_start >= (SELECT max(week_start) FROM scored) - 6")
def latest_all(spark, sf):
    return _flat(stress.latest_scores(materialise(d.weekly(spark, sf), "weekly")))


@query("chart_series", f"""
SELECT fips, year, strftime(week_start, '%m-%d') AS date, week_of_season AS week, overall_stress_index AS overall,
  water_value AS water, heat_value AS heat, vegetation_value AS vegetation, atmosphere_value AS atmosphere FROM scored""")
def chart_series(spark, sf):
    return stress.chart_series(d.scored(spark, sf))


@query("county_week_lookup", """
req AS (SELECT o_orderkey AS request_id, CAST(19000 + o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS fips,
  CAST(o_orderdate AS DATE) AS day FROM orders),
hit AS (SELECT request_id, min(week_start) AS week_start FROM req r JOIN scored s ON r.fips = s.fips
  AND s.week_start BETWEEN r.day AND r.day + 6 GROUP BY request_id)
--
SELECT r.request_id, r.fips, CAST(r.day AS VARCHAR) AS day, h.request_id IS NOT NULL AS found,
  CAST(s.week_start AS VARCHAR) AS week_start, s.overall_stress_index, s.overall_status
FROM req r LEFT JOIN hit h ON r.request_id = h.request_id
LEFT JOIN scored s ON s.fips = r.fips AND s.week_start = h.week_start""")
def county_week_lookup(spark, sf):
    counties = d.table(spark, sf, "supplier").agg(F.count("*")).scalar()
    requests = d.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), d.county_code(F.col("o_custkey") % counties).alias("fips"),
        F.to_date("o_orderdate").alias("day"))
    scores = d.scored(spark, sf).select("fips", "week_start", "overall_stress_index", "overall_status")
    return joins.county_week(requests, scores)


@query("water_step_test", """
SELECT CAST(date AS VARCHAR) AS date, fips, CASE WHEN water_deficit_mean < 0 THEN 0 WHEN water_deficit_mean < 2 THEN 20
  WHEN water_deficit_mean < 4 THEN 50 WHEN water_deficit_mean < 6 THEN 75 ELSE 100 END AS stress FROM obsd""")
def water_step_test(spark, sf):
    return d.observations(spark, sf).select(
        "date", "fips", bands.deficit_step(F.col("water_deficit_mean")).alias("stress"))


@query("ndvi_ratio_step_test", f"""
n AS (SELECT fips, week_of_season, round(avg(ndvi_mean), 9) AS m FROM daily GROUP BY fips, week_of_season),
q AS (SELECT w.fips, w.year, w.week_of_season, ndvi_mean / nullif(m, 0e0) AS q FROM weekly w
  LEFT JOIN n ON w.fips = n.fips AND w.week_of_season = n.week_of_season)
--
SELECT {KEY_SQL}, CASE WHEN q IS NULL THEN NULL WHEN q > 1 THEN 0 WHEN q > 0.9e0 THEN 20 WHEN q > 0.8e0 THEN 50
  WHEN q > 0.7e0 THEN 75 ELSE 100 END AS stress FROM q""")
def ndvi_ratio_step_test(spark, sf):
    daily = materialise(d.daily(spark, sf), "daily")
    joined = joins.with_normals(d.snapped(rollup.weekly(daily)), d.snapped(rollup.climatology(daily)))
    return joined.select(*KEYS, bands.ndvi_ratio_step(F.col("ndvi_mean"), F.col("ndvi_mean_mean")).alias("stress"))


def banded_sql(value: str, table) -> str:
    parts = []
    for low, high, at_low, at_high in table:
        scaled = (f"{at_low}e0 + (least(greatest({value}, {low}e0), {high}e0) - {low}e0) / ({high}e0 - {low}e0) "
                  f"* ({at_high}e0 - {at_low}e0)")
        parts.append((f"{value} < {high}e0", scaled))
    body = " ".join(f"WHEN {c} THEN {v}" for c, v in parts[:-1])
    return f"CASE WHEN {value} IS NULL THEN NULL {body} ELSE {parts[-1][1]} END"


HEALTH_SQL = f"""
h AS (SELECT *, {banded_sql('ndvi_mean', HEALTH_BANDS['ndvi'])} AS b1, {banded_sql('lst_mean', HEALTH_BANDS['lst'])} AS b2,
  {banded_sql('vpd_mean', HEALTH_BANDS['vpd'])} AS b3, {banded_sql('(water_deficit_mean * 7)', HEALTH_BANDS['water'])} AS b4
  FROM weekly),
hi AS (SELECT *, CASE """ + " ".join(
    f"WHEN week_of_season <= {last} THEN 0e0 + b1 * {w1} + b2 * {w2} + b3 * {w3} + b4 * {w4}"
    for last, w1, w2, w3, w4 in HEALTH_WEIGHTS) + " END AS health_index FROM h)"


@query("health_index_k", HEALTH_SQL + f"""
--
SELECT {KEY_SQL}, {r6('b1')} AS ndvi_score, {r6('b2')} AS lst_score, {r6('b3')} AS vpd_score, {r6('b4')} AS water_score,
  {r6s('health_index')} FROM hi""")
def health_index_k(spark, sf):
    return stress.health_index(d.weekly(spark, sf)).select(
        *KEYS, "ndvi_score", "lst_score", "vpd_score", "water_score", "health_index")


@query("growth_stage", f"""
SELECT {KEY_SQL}, CASE week_of_season """ + " ".join(f"WHEN {w} THEN '{t}'" for w, t in WEEK_HINTS.items())
       + " END AS stage_hint, CASE " + " ".join(
           f"WHEN week_of_season BETWEEN {a} AND {b} THEN '{t}'" for a, b, t in GROWTH_WINDOWS)
       + " END AS growth_window FROM weekly")
def growth_stage(spark, sf):
    return stress.with_growth_stage(d.weekly(spark, sf)).select(*KEYS, "stage_hint", "growth_window")


@query("yield_factor", HEALTH_SQL + f""",
p AS (SELECT fips, year, round(avg(health_index), 6) AS x FROM hi WHERE week_of_season BETWEEN 10 AND 12 GROUP BY fips, year)
--
SELECT fips, year, {r6('x')} AS pollination_index, CASE WHEN x IS NULL THEN NULL WHEN x > 80 THEN '100%'
  WHEN x >= 60 THEN '90-100%' WHEN x >= 40 THEN '70-90%' WHEN x >= 20 THEN '50-70%' ELSE '<50%' END AS share FROM p""")
def yield_factor(spark, sf):
    flowering = stress.health_index(d.weekly(spark, sf)).filter(F.col("week_of_season").between(10, 12))
    index = flowering.groupBy("fips", "year").agg(F.round(F.avg("health_index"), 6).alias("pollination_index"))
    return index.withColumn("share", bands.yield_factor(F.col("pollination_index")))


