"""Queries over the grid, the joins, the roll-ups and the ordered operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from furrow.config import HEAT_UNIT_STAGES, INDICATORS, PIXEL_INDICATORS
from furrow.functions import bands, calendar, scalars
from furrow.operators import fill, grid, joins, rollup, stress, windows
from furrow.plans import domain as d
from furrow.plans.base_sql import ALL, half_up, r6, r6s, weekly_sql
from furrow.plans.ingestion import DAILY_OUT, DAILY_SQL
from furrow.plans.registry import query
from furrow.session import materialise
from furrow.sources import readers

# ---- grid and calendar


@query("season_grid", """
SELECT CAST(date AS VARCHAR) AS date, fips, county_name, year, month, doy, week_of_season FROM grid""")
def season_grid(spark, sf):
    return d.season_grid(spark, sf)


@query("county_dim", "SELECT fips, county_name FROM dim")
def county_dim(spark, sf):
    return grid.county_dim(d.indicator(spark, sf, "ndvi"))


@query("calendar_features", """
SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, dayofyear(o_orderdate) AS doy,
  CAST(floor((CAST(o_orderdate AS DATE) - make_date(year(o_orderdate), 5, 1)) / 7e0) + 1 AS BIGINT) AS week_of_season
FROM orders""")
def calendar_features(spark, sf):
    orders = d.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return calendar.with_calendar(orders).drop("date")


@query("rename_stats", f"SELECT CAST(date AS VARCHAR) AS date, fips, {r6s('vpd_mean', 'vpd_std')} FROM obs")
def rename_stats(spark, sf):
    return grid.prefixed(d.indicator(spark, sf, "vpd"), "vpd")


@query("select_by_suffix", "SELECT fips, year, week_of_season, " + r6s(*[f"{n}_std" for n in ALL]) + " FROM weekly")
def select_by_suffix(spark, sf):
    weekly = d.weekly(spark, sf)
    return weekly.select("fips", "year", "week_of_season", *scalars.suffix_cols(weekly, "_std"))


@query("week_start", """
SELECT DISTINCT year, week_of_season, CAST(make_date(year, 5, 1) + CAST(7 * (week_of_season - 1) AS INTEGER) AS VARCHAR)
  AS week_start FROM grid""")
def week_start(spark, sf):
    weeks = d.season_grid(spark, sf).select("year", "week_of_season").distinct()
    return weeks.withColumn("week_start", calendar.week_start(F.col("year"), F.col("week_of_season")))


ZERO = "zero AS (SELECT " + ", ".join(DAILY_OUT[:7]) + ", " + ", ".join(
    f"coalesce({c}, 0e0) AS {c}" for c in DAILY_OUT[7:]) + " FROM daily)"


@query("zero_fill", ZERO + "\n--\n" + DAILY_SQL.format(source="zero"))
def zero_fill(spark, sf):
    return fill.fill(d.daily(spark, sf), "zero")


@query("locf_fill", f"""
SELECT CAST(date AS VARCHAR) AS date, fips,
  {r6('last_value(ndvi_mean IGNORE NULLS) OVER w')} AS ndvi_mean,
  {r6('last_value(lst_mean IGNORE NULLS) OVER w')} AS lst_mean
FROM daily WINDOW w AS (PARTITION BY fips, year ORDER BY date ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def locf_fill(spark, sf):
    return fill.fill(d.daily(spark, sf), "locf", ["ndvi_mean", "lst_mean"]).select(
        "date", "fips", "ndvi_mean", "lst_mean")


@query("linear_fill", f"""
marked AS (SELECT date, fips, vpd_mean AS v,
  last_value(CASE WHEN vpd_mean IS NOT NULL THEN date END IGNORE NULLS) OVER b AS d0,
  last_value(vpd_mean IGNORE NULLS) OVER b AS v0,
  first_value(CASE WHEN vpd_mean IS NOT NULL THEN date END IGNORE NULLS) OVER a AS d1,
  first_value(vpd_mean IGNORE NULLS) OVER a AS v1
  FROM daily WINDOW b AS (PARTITION BY fips, year ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY fips, year ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
--
SELECT CAST(date AS VARCHAR) AS date, fips,
  {r6('CASE WHEN v IS NOT NULL THEN v ELSE v0 + (v1 - v0) * ((date - d0) / CAST(d1 - d0 AS DOUBLE)) END')} AS vpd_mean
FROM marked""")
def linear_fill(spark, sf):
    return fill.fill(d.daily(spark, sf), "linear", ["vpd_mean"]).select("date", "fips", "vpd_mean")


@query("skip_bad_rows", """
SELECT CASE WHEN o_orderkey % 10 IN (3, 7) THEN 'rejected' ELSE 'loaded' END AS outcome, count(*) AS rows,
  CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders GROUP BY 1""")
def skip_bad_rows(spark, sf):
    orders = d.table(spark, sf, "orders")
    key = F.col("o_orderkey") % 10
    raw = orders.select(
        "o_custkey", F.when(key == 3, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("mean"),
        F.when(key == 7, "2001-13-45").otherwise(F.to_date("o_orderdate").cast("string")).alias("date"))
    good, bad = readers.split_bad_rows(raw, {"mean": "double", "date": "date"})
    parts = [p.groupBy().agg(F.lit(n).alias("outcome"), F.count("*").alias("rows"), F.sum("o_custkey").alias("customers"))
             for n, p in (("loaded", good), ("rejected", bad))]
    return parts[0].unionByName(parts[1])


@query("fips_valid", """
SELECT c_custkey, regexp_matches(code, '^19[0-9]{3}$') AS valid FROM (
  SELECT c_custkey, CAST(c_custkey * 13 + 15000 AS VARCHAR) AS code FROM customer)""")
def fips_valid(spark, sf):
    code = (F.col("c_custkey") * 13 + 15000).cast("string")
    return d.table(spark, sf, "customer").select("c_custkey", scalars.is_valid_fips(code).alias("valid"))


@query("date_valid", """
SELECT o_orderkey, o_orderkey % 28 + 1 <= 12 AS valid FROM orders""")
def date_valid(spark, sf):
    month = (F.col("o_orderkey") % 28 + 1).cast("string")
    text = F.concat_ws("-", F.year("o_orderdate").cast("string"), F.lpad(month, 2, "0"), F.lit("15"))
    return d.table(spark, sf, "orders").select("o_orderkey", scalars.is_iso_date(text).alias("valid"))


@query("drop_nulls", f"""
SELECT fips, count(*) AS days, {r6('avg(ndvi_mean)')} AS mean_ndvi FROM daily WHERE ndvi_mean IS NOT NULL GROUP BY fips""")
def drop_nulls(spark, sf):
    return d.daily(spark, sf).dropna(subset=["ndvi_mean"]).groupBy("fips").agg(
        F.count("*").alias("days"), F.avg("ndvi_mean").alias("mean_ndvi"))


@query("county_slice", f"""
SELECT CAST(week_start AS VARCHAR) AS week_start, week_of_season, {r6s('ndvi_mean', 'lst_mean', 'pr_sum')}
FROM weekly WHERE fips = '19003'""")
def county_slice(spark, sf):
    return d.weekly(spark, sf).filter(F.col("fips") == "19003").select(
        "week_start", "week_of_season", "ndvi_mean", "lst_mean", "pr_sum")


@query("date_window_slice", f"""
SELECT fips, CAST(week_start AS VARCHAR) AS week_start, {r6s('ndvi_mean', 'pr_sum')} FROM weekly
WHERE week_start >= DATE '1997-06-01' AND week_start <= DATE '1999-08-07'""")
def date_window_slice(spark, sf):
    return calendar.between_dates(d.weekly(spark, sf), "1997-06-01", "1999-08-07", "week_start",
                                  inclusive_end=True).select("fips", "week_start", "ndvi_mean", "pr_sum")


@query("yield_band", """
SELECT fips, year, yield_bu_per_acre, CASE WHEN yield_bu_per_acre < 80 THEN 'severe drought'
  WHEN yield_bu_per_acre < 120 THEN 'below typical' WHEN yield_bu_per_acre <= 200 THEN 'typical'
  ELSE 'excellent' END AS band FROM yields""")
def yield_band(spark, sf):
    return d.yields(spark, sf).select("fips", "year", "yield_bu_per_acre",
                                      bands.yield_band(F.col("yield_bu_per_acre")).alias("band"))


@query("rain_class", """
SELECT CAST(date AS VARCHAR) AS date, fips, CASE WHEN pr_sum <= 0 THEN 'dry' WHEN pr_sum <= 5 THEN 'light'
  WHEN pr_sum <= 15 THEN 'moderate' WHEN pr_sum <= 25 THEN 'heavy' WHEN pr_sum <= 50 THEN 'very heavy'
  ELSE 'extreme' END AS rain FROM (
  SELECT date, fips, sum(pr) * 3 AS pr_sum FROM px WHERE crop_class = 1 AND month(date) BETWEEN 5 AND 10
  GROUP BY date, fips)""")
def rain_class(spark, sf):
    mm = d.season_readings(spark, sf).filter(grid.crop_mask() == 1).groupBy("date", "fips").agg(
        (F.sum("pr") * 3).alias("mm"))
    return mm.select("date", "fips", bands.rain_class(F.col("mm")).alias("rain"))


# ---- joins


@query("daily_merge", DAILY_SQL.format(source="daily"))
def daily_merge(spark, sf):
    # the pixels are reduced once; the six tables are read off the written result
    wide = materialise(d.observations(spark, sf), "observations")
    parts = {n: wide.select("date", "fips", F.lit(None).cast("string").alias("county_name"),
                            F.col(f"{n}_mean").alias("mean"), F.col(f"{n}_std").alias("std")) for n in PIXEL_INDICATORS}
    deficit = grid.water_deficit(parts["eto"], parts["pr"])
    return grid.daily_clean(d.season_grid(spark, sf), parts, deficit).select(*DAILY_OUT)


@query("water_deficit_join", f"""
SELECT CAST(date AS VARCHAR) AS date, fips, county_name, {r6s('eto_mean', 'pr_mean', 'eto_std', 'pr_std')},
  {r6('water_deficit_mean')} AS water_deficit, mask_year FROM obsd""")
def water_deficit_join(spark, sf):
    return grid.water_deficit(d.indicator(spark, sf, "eto"), d.indicator(spark, sf, "pr"))


@query("county_name_lookup", """
SELECT l_orderkey, l_linenumber, CAST(19000 + l_suppkey AS VARCHAR) AS fips, county_name
FROM lineitem LEFT JOIN dim ON fips = CAST(19000 + l_suppkey AS VARCHAR)""")
def county_name_lookup(spark, sf):
    lines = d.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", d.county_code(F.col("l_suppkey")).alias("fips"))
    return joins.with_county_name(lines, d.counties(spark, sf)).select(
        "l_orderkey", "l_linenumber", "fips", "county_name")


CLIM = ("clim AS (SELECT week_of_season, fips, county_name, "
        + ", ".join(f"{r6(f'avg({n}_mean)')} AS {n}_mean_mean, {r6(f'stddev_samp({n}_mean)')} AS {n}_mean_std" for n in ALL)
        + " FROM daily GROUP BY week_of_season, fips, county_name)")


@query("climatology_join", CLIM + f"""
--
SELECT w.fips, w.year, w.week_of_season, {r6s('ndvi_mean', 'ndvi_mean_mean', 'ndvi_mean_std')}
FROM weekly w LEFT JOIN clim c ON w.fips = c.fips AND w.week_of_season = c.week_of_season""")
def climatology_join(spark, sf):
    daily = materialise(d.daily(spark, sf), "daily")
    return joins.with_normals(d.snapped(rollup.weekly(daily)), rollup.climatology(daily)).select(
        "fips", "year", "week_of_season", "ndvi_mean", "ndvi_mean_mean", "ndvi_mean_std")


@query("yield_training_join", f"""
f AS (SELECT fips, year, {r6('sum(water_deficit_mean)')} AS total_deficit, {r6('avg(ndvi_mean)')} AS mean_ndvi
  FROM weekly GROUP BY fips, year)
--
SELECT f.*, y.yield_bu_per_acre FROM f JOIN yields y ON f.fips = y.fips AND f.year = y.year""")
def yield_training_join(spark, sf):
    features = d.weekly(spark, sf).groupBy("fips", "year").agg(
        F.sum("water_deficit_mean").alias("total_deficit"), F.avg("ndvi_mean").alias("mean_ndvi"))
    return joins.training_set(features, d.yields(spark, sf))


GDD = """
temps AS (SELECT date, fips, year(date) AS year, max(lst) * 9 / 5e0 + 32 AS tmax, min(lst) * 9 / 5e0 + 32 AS tmin
  FROM px WHERE crop_class = 1 AND month(date) BETWEEN 5 AND 10 GROUP BY date, fips),
units AS (SELECT date, fips, year,
  round(greatest((least(tmax, 86e0) + least(tmin, 86e0)) / 2 - 50, 0e0), 9) AS gdd FROM temps)"""


def _heat_units(spark, sf):
    """Daily heat units in degrees F from the extremes of the day's pixels."""
    temps = d.season_readings(spark, sf).filter(grid.crop_mask() == 1).groupBy("date", "fips").agg(
        (F.max("lst") * 9 / 5 + 32).alias("tmax"), (F.min("lst") * 9 / 5 + 32).alias("tmin"))
    return temps.select("date", "fips", F.year("date").alias("year"), d.snap(
        rollup.growing_degree_days(F.col("tmax"), F.col("tmin"), base=50.0, cap=86.0)).alias("gdd"))


@query("growing_degree_days", GDD + f"""
--
SELECT fips, year, {r6('sum(gdd)')} AS season_gdd, count(*) AS days FROM units GROUP BY fips, year""")
def growing_degree_days(spark, sf):
    return _heat_units(spark, sf).groupBy("fips", "year").agg(
        F.sum("gdd").alias("season_gdd"), F.count("*").alias("days"))


STAGES_SQL = ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in HEAT_UNIT_STAGES)


@query("gdd_stage_range_join", GDD + f""",
run AS (SELECT date, fips, round(sum(gdd) OVER (PARTITION BY fips, year ORDER BY date), 9) AS cum_gdd FROM units),
stages(stage, low, high) AS (VALUES {STAGES_SQL})
--
SELECT CAST(date AS VARCHAR) AS date, fips, {r6('cum_gdd')} AS cum_gdd, stage FROM run LEFT JOIN stages ON cum_gdd >= low AND cum_gdd < high""")
def gdd_stage_range_join(spark, sf):
    so_far = Window.partitionBy("fips", "year").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    run = _heat_units(spark, sf).select("date", "fips", d.snap(F.sum("gdd").over(so_far)).alias("cum_gdd"))
    stages = spark.createDataFrame(list(HEAT_UNIT_STAGES), "stage string, low double, high double")
    return joins.range_join(run, stages, "cum_gdd", "low", "high", width=100.0).drop("low", "high")


# ---- aggregates

W_OUT = ("year", "week_of_season", "fips", "county_name", *[f"{n}_{s}" for n in INDICATORS for s in ("mean", "std")])


@query("weekly_rollup", ZERO + f", wz AS ({weekly_sql('zero')})\n--\n"
       + "SELECT CAST(week_start AS VARCHAR) AS week_start, " + ", ".join(W_OUT[:4]) + ", " + r6s(*W_OUT[4:]) + " FROM wz")
def weekly_rollup(spark, sf):
    """The published form: gaps filled with zero before the roll-up."""
    zero = fill.fill(d.daily(spark, sf), "zero")
    return rollup.weekly(zero, totals=False)


@query("weekly_totals", """
SELECT CAST(week_start AS VARCHAR) AS week_start, fips, lst_days_above_32, """
       + r6s("pr_sum", "eto_sum", "water_deficit_sum", "ndvi_min", "ndvi_max", "lst_max", "vpd_max") + " FROM weekly")
def weekly_totals(spark, sf):
    return d.weekly(spark, sf).select(
        "week_start", "fips", "pr_sum", "eto_sum", "water_deficit_sum", "ndvi_min", "ndvi_max", "lst_max", "vpd_max",
        "lst_days_above_32")


@query("climatology", CLIM + "\n--\nSELECT * FROM clim")
def climatology(spark, sf):
    return rollup.climatology(d.daily(spark, sf))


def _share(cond: str) -> str:
    return r6(f"avg(CASE WHEN {cond} THEN 1e0 ELSE 0e0 END)")


@query("run_metadata", f"""
SELECT count(*) AS daily_records, (SELECT count(*) FROM weekly) AS weekly_records, count(DISTINCT fips) AS counties,
  CAST(min(date) AS VARCHAR) AS date_range_start, CAST(max(date) AS VARCHAR) AS date_range_end,
  {_share('ndvi_mean > 0')} AS ndvi, {_share('lst_mean > 0')} AS lst, {_share('vpd_mean > 0')} AS vpd,
  {_share('eto_mean > 0')} AS eto, {_share('pr_mean >= 0')} AS pr, {_share('water_deficit_mean <> 0')} AS water_deficit
FROM daily""")
def run_metadata(spark, sf):
    return rollup.run_metadata(d.daily(spark, sf)).select(
        "daily_records", "weekly_records", "counties", "date_range_start", "date_range_end", "data_completeness.*")


@query("nonzero_share", "\nUNION ALL ".join(
    f"SELECT '{n}_mean' AS indicator, "
    f"{r6(f'avg(CASE WHEN {n}_mean > 0 THEN 1e0 ELSE 0e0 END) * 100')} AS nonzero_pct FROM daily" for n in ALL))
def nonzero_share(spark, sf):
    return rollup.nonzero_share(d.daily(spark, sf), [f"{n}_mean" for n in INDICATORS])


@query("deficit_histogram", f"""
b AS (SELECT water_deficit_mean AS x, CASE WHEN water_deficit_mean < 0 THEN 'surplus' WHEN water_deficit_mean <= 2
  THEN 'normal' WHEN water_deficit_mean <= 4 THEN 'moderate' WHEN water_deficit_mean <= 6 THEN 'high'
  ELSE 'severe' END AS band FROM obsd)
--
SELECT (SELECT count(*) FROM b) AS total, {r6('(SELECT avg(x) FROM b)')} AS mean_deficit, band, count(*) AS n,
  {r6('count(*) * 100e0 / (SELECT count(*) FROM b)')} AS pct FROM b GROUP BY band""")
def deficit_histogram(spark, sf):
    return rollup.deficit_histogram(d.observations(spark, sf), "water_deficit_mean")


@query("rain_day_stats", f"""
SELECT count(pr_mean) AS days, count(*) FILTER (WHERE pr_mean = 0) AS dry_days,
  count(*) FILTER (WHERE pr_mean > 0) AS wet_days, count(*) FILTER (WHERE pr_mean > 25) AS heavy_days,
  {r6('count(*) FILTER (WHERE pr_mean = 0) * 100e0 / count(pr_mean)')} AS dry_pct,
  {r6('count(*) FILTER (WHERE pr_mean > 0) * 100e0 / count(pr_mean)')} AS wet_pct,
  {r6('count(*) FILTER (WHERE pr_mean > 25) * 100e0 / count(pr_mean)')} AS heavy_pct FROM obs""")
def rain_day_stats(spark, sf):
    return rollup.rain_day_stats(d.observations(spark, sf))


@query("yield_stats", f"""
SELECT year, count(*) AS records, min(yield_bu_per_acre) AS min_yield, max(yield_bu_per_acre) AS max_yield,
  {r6('avg(yield_bu_per_acre)')} AS mean_yield, count(DISTINCT fips) AS counties
FROM yields GROUP BY GROUPING SETS ((year), ())""")
def yield_stats(spark, sf):
    return rollup.yield_stats(d.yields(spark, sf))


@query("critical_period_sum", f"""
SELECT fips, year, {r6('sum(CASE WHEN doy BETWEEN 196 AND 227 THEN water_deficit_mean END)')} AS critical_deficit,
  count(*) FILTER (WHERE lst_mean > 35) AS heat_days FROM daily GROUP BY fips, year""")
def critical_period_sum(spark, sf):
    return rollup.critical_period(d.daily(spark, sf))


@query("deficit_accumulation", f"""
SELECT fips, year, {r6('sum(water_deficit_mean)')} AS total_deficit, {r6('avg(water_deficit_mean)')} AS mean_deficit
FROM daily GROUP BY fips, year""")
def deficit_accumulation(spark, sf):
    return rollup.deficit_accumulation(d.daily(spark, sf))


SUMMARY = """
r AS (SELECT *, row_number() OVER (PARTITION BY week_start ORDER BY overall_stress_index DESC, fips) AS hi,
  row_number() OVER (PARTITION BY week_start ORDER BY overall_stress_index, fips) AS lo FROM scored),
line AS (SELECT *, concat_ws(':', fips, county_name, format('{:.2f}', overall_stress_index), overall_status) AS t FROM r)"""


@query("state_summary", SUMMARY + f"""
--
SELECT CAST(week_start AS VARCHAR) AS week_start, count(*) AS counties_analyzed,
  {half_up('avg(overall_stress_index)')} AS average_stress_index,
  max(overall_stress_index) AS max_stress_index, min(overall_stress_index) AS min_stress_index,
  {half_up('stddev_pop(overall_stress_index)')} AS std_stress_index,
  string_agg(t, '|' ORDER BY hi) FILTER (WHERE hi <= 5) AS critical_counties,
  string_agg(t, '|' ORDER BY lo) FILTER (WHERE lo <= 5) AS healthy_counties
FROM line GROUP BY week_start""")
def state_summary(spark, sf):
    # three aggregates read the scores, so they are written once
    scores = materialise(d.scored(spark, sf).select(
        "week_start", "fips", "county_name", "overall_stress_index", "overall_status"), "scores")
    summary = rollup.state_summary(scores)

    def line(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(
            ":", x["fips"], x["county_name"], F.format_string("%.2f", x["stress_index"]), x["status"])), "|")

    return summary.withColumns({c: line(F.col(c)) for c in ("critical_counties", "healthy_counties")})


@query("index_yield_r2", "\nUNION ALL ".join(f"""
SELECT '{n}' AS period, {r6('pow(corr(m, yield_bu_per_acre), 2)')} AS r2 FROM (
  SELECT s.fips, s.year, avg(overall_stress_index) AS m FROM scored s WHERE week_of_season BETWEEN {lo} AND {hi}
  GROUP BY s.fips, s.year) x JOIN yields y ON x.fips = y.fips AND x.year = y.year"""
       for n, lo, hi in (("pollination", 10, 12), ("early grain fill", 13, 16), ("season", 1, 27))))
def index_yield_r2(spark, sf):
    return rollup.index_yield_r2(d.scored(spark, sf), d.yields(spark, sf))


@query("index_distribution", f"""
SELECT CAST(week_start AS VARCHAR) AS week_start, count(*) AS n, {r6('avg(overall_stress_index)')} AS mean,
  {r6('stddev_samp(overall_stress_index)')} AS std, min(overall_stress_index) AS min, max(overall_stress_index) AS max
FROM scored GROUP BY week_start""")
def index_distribution(spark, sf):
    return rollup.index_distribution(d.scored(spark, sf))


@query("latency_percentiles", f"""
SELECT event_type AS kind, count(*) AS requests, {r6('quantile_cont(value, 0.5)')} AS p50,
  {r6('quantile_cont(value, 0.95)')} AS p95, {r6('quantile_cont(value, 0.99)')} AS p99,
  {r6('avg(user_id % 6)')} AS mean_sources,
  {r6("avg(CASE WHEN event_type <> 'error' AND event_id % 20 <> 0 THEN 1e0 ELSE 0e0 END)")} AS success_share
FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf):
    logs = d.table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.col("value").alias("latency_ms"), (F.col("user_id") % 6).alias("sources"),
        F.when((F.col("event_type") != "error") & (F.col("event_id") % 20 != 0), "success").otherwise("failed").alias("status"))
    return rollup.latency_stats(logs)


# ---- ordered operators


@query("rolling_stats", f"""
SELECT CAST(date AS VARCHAR) AS date, fips, {r6('CASE WHEN count(lst_mean) OVER w = 7 THEN avg(lst_mean) OVER w END')}
  AS lst_mean_roll_mean, {r6('CASE WHEN count(lst_mean) OVER w = 7 THEN stddev_samp(lst_mean) OVER w END')}
  AS lst_mean_roll_std
FROM obs WINDOW w AS (PARTITION BY fips ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_stats(spark, sf):
    return windows.rolling(d.observations(spark, sf).select("date", "fips", "lst_mean"), "lst_mean").drop("lst_mean")


@query("rolling_deficit_7d", f"""
SELECT CAST(date AS VARCHAR) AS date, fips, {r6('avg(water_deficit_mean) OVER w')} AS water_deficit_mean_7d FROM obsd
WINDOW w AS (PARTITION BY fips ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""")
def rolling_deficit_7d(spark, sf):
    obs = d.observations(spark, sf).select("date", "fips", "water_deficit_mean")
    return windows.rolling_days(obs, "water_deficit_mean").drop("water_deficit_mean")


@query("max_gap", """
SELECT fips, year, max(gap) AS max_gap_days FROM (SELECT fips, year(date) AS year,
  date - lag(date) OVER (PARTITION BY fips, year(date) ORDER BY date) AS gap FROM obs) GROUP BY fips, year""")
def max_gap(spark, sf):
    return windows.max_gap(d.indicator(spark, sf, "ndvi").withColumn("year", F.year("date")))


@query("dry_spell_runs", """
runs AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY fips, year ORDER BY date) AS INTEGER) AS island
  FROM daily WHERE coalesce(pr_mean, 0) < 2)
--
SELECT fips, year, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day, count(*) AS days
FROM runs GROUP BY fips, year, island HAVING count(*) >= 7""")
def dry_spell_runs(spark, sf):
    return windows.spells(d.daily(spark, sf), F.coalesce("pr_mean", F.lit(0.0)) < 2)


@query("cum_features", f"""
SELECT fips, year, week_of_season, {r6('sum(water_deficit_mean) OVER w')} AS cumsum_water_deficit,
  CAST(sum(lst_days_above_32) OVER w AS BIGINT) AS cumsum_heat_days, {r6('sum(vpd_mean) OVER w')} AS cumsum_vpd,
  {r6('sum(pr_sum) OVER w')} AS cumsum_precip,
  max(CASE WHEN week_of_season BETWEEN 7 AND 11 THEN lst_days_above_32 END) OVER w AS max_heat_pollination,
  {r6('ndvi_mean')} AS ndvi_current, CAST(week_of_season BETWEEN 7 AND 11 AS BIGINT) AS is_pollination
FROM weekly WINDOW w AS (PARTITION BY fips, year ORDER BY week_of_season
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def cum_features(spark, sf):
    return windows.cumulative_features(d.weekly(spark, sf), pollination=(7, 11))


@query("week_trend", """
p AS (SELECT fips, week_start, overall_stress_index AS x,
  lag(overall_stress_index) OVER (PARTITION BY fips, year ORDER BY week_start) AS y FROM scored)
--
SELECT fips, CAST(week_start AS VARCHAR) AS week_start, x AS overall_stress_index, y AS previous_index,
  CASE WHEN y IS NULL THEN NULL WHEN abs(x - y) <= abs(y) * 0.05e0 THEN 'stable' WHEN x < y THEN 'improving'
  ELSE 'declining' END AS trend FROM p""")
def week_trend(spark, sf):
    return windows.with_trend(d.scored(spark, sf)).select(
        "fips", "week_start", "overall_stress_index", "previous_index", "trend")


@query("historical_percentile", f"""
SELECT fips, year, week_of_season, overall_stress_index,
  {r6('percent_rank() OVER (PARTITION BY fips, week_of_season ORDER BY overall_stress_index) * 100')}
  AS historical_percentile FROM scored""")
def historical_percentile(spark, sf):
    return windows.with_percentile(d.scored(spark, sf)).select(
        "fips", "year", "week_of_season", "overall_stress_index", "historical_percentile")


Z_SQL = """
n AS (SELECT fips, week_of_season, round(avg(overall_stress_index), 9) AS m, round(stddev_samp(overall_stress_index), 9) AS s
  FROM scored GROUP BY fips, week_of_season),
z AS (SELECT x.fips, x.year, x.week_of_season, (overall_stress_index - m) / nullif(s, 0e0) AS z
  FROM scored x JOIN n ON x.fips = n.fips AND x.week_of_season = n.week_of_season)"""


def _anomalies(spark, sf):
    scored = materialise(d.scored(spark, sf).select("fips", "year", "week_of_season", "overall_stress_index"), "scores")
    normals = d.snapped(windows.week_normals(scored))
    return windows.with_anomaly(scored, normals, "overall_stress_index", "index_mean", "index_std")


@query("anomaly_z", Z_SQL + f"""
--
SELECT fips, year, week_of_season, {r6('z')} AS anomaly FROM z""")
def anomaly_z(spark, sf):
    return _anomalies(spark, sf).select("fips", "year", "week_of_season", "anomaly")


@query("anomaly_class", Z_SQL + """
--
SELECT fips, year, week_of_season, CASE WHEN z IS NULL THEN NULL WHEN abs(z) <= 0.5e0 THEN 'normal'
  WHEN abs(z) <= 1e0 THEN 'mild' WHEN abs(z) <= 2e0 THEN 'moderate' ELSE 'severe' END AS anomaly_class FROM z""")
def anomaly_class(spark, sf):
    return _anomalies(spark, sf).select(
        "fips", "year", "week_of_season", bands.anomaly_class(F.col("anomaly")).alias("anomaly_class"))


@query("timeseries_tail", """
t AS (SELECT *, row_number() OVER (PARTITION BY fips ORDER BY week_start DESC) AS rn FROM scored)
--
SELECT fips, CAST(week_start AS VARCHAR) AS week_start, overall_stress_index, overall_status FROM t WHERE rn <= 20""")
def timeseries_tail(spark, sf):
    return d.recent_scores(spark, sf, 20).select(
        "fips", "week_start", "overall_stress_index", "overall_status").orderBy("fips", "week_start")


@query("latest_week", f"""
SELECT fips, county_name, week_of_season, CAST(week_start AS VARCHAR) AS week_start, {r6s('ndvi_mean', 'lst_mean', 'pr_sum')}
FROM weekly WHERE week_start >= (SELECT max(week_start) FROM weekly) - 6""")
def latest_week(spark, sf):
    return joins.latest_week(d.weekly(spark, sf)).select(
        "fips", "county_name", "week_of_season", "week_start", "ndvi_mean", "lst_mean", "pr_sum")


# ---- sorts, limits, set operations


@query("sort_key", f"SELECT fips, year, week_of_season, {r6s('lst_mean')} FROM weekly")
def sort_key(spark, sf):
    return d.weekly(spark, sf).select("fips", "year", "week_of_season", "lst_mean").orderBy(
        F.asc_nulls_last("lst_mean"), "fips", "year", "week_of_season")


for _name, _dir in (("top_stressed", True), ("top_healthy", False)):
    def _top(spark, sf, _dir=_dir):
        latest = stress.latest_scores(d.weekly(spark, sf))
        return rollup.top_k(latest, "overall_stress_index", 5, _dir).select(
            "fips", "county_name", "overall_stress_index", "overall_status")

    query(_name, f"""
SELECT fips, county_name, overall_stress_index, overall_status FROM scored
WHERE week_start = (SELECT max(week_start) FROM scored)
ORDER BY overall_stress_index {'DESC' if _dir else 'ASC'}, fips LIMIT 5""")(_top)


@query("union_all", """
SELECT indicator, count(*) AS rows, min(fips) AS first_fips FROM (
  SELECT 'eto' AS indicator, fips FROM obs UNION ALL SELECT 'pr', fips FROM obs) GROUP BY indicator""")
def union_all(spark, sf):
    parts = [d.indicator(spark, sf, n).withColumn("indicator", F.lit(n)) for n in ("eto", "pr")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).groupBy("indicator").agg(
        F.count("*").alias("rows"), F.min("fips").alias("first_fips"))


@query("distinct_values", "SELECT DISTINCT fips, week_of_season FROM weekly")
def distinct_values(spark, sf):
    return d.weekly(spark, sf).select("fips", "week_of_season").distinct().orderBy("fips", "week_of_season")
