"""The incremental jobs run as streams over the driver's tables, to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.plans import domain as d
from furrow.plans.base_sql import LST_RAW, clamp, half_up, r6, r6s, status, weighted, week_of
from furrow.plans.registry import query
from furrow.session import new_path
from furrow.streaming import alerts, streams


def read_stream(spark, sf_dir: str, name: str):
    """A driver table as a stream of files; the table may be a file or a directory.

    The path is written as a pattern, since a stream takes a plain path for a directory.
    """
    schema = d.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def events(spark, sf):
    """Readings per user, moved from January into the season (+121 days)."""
    stream = read_stream(spark, sf, "events")
    return stream.select(
        (F.col("ts").cast("timestamp") + F.expr("INTERVAL 121 DAYS")).alias("ts"),
        d.county_code(F.col("user_id")).alias("fips"), "event_id", "event_type", F.col("value").alias("mean"))


EV = """
ev AS (SELECT ts + INTERVAL 121 DAY AS ts, CAST(19000 + user_id AS VARCHAR) AS fips, event_id, event_type, value AS mean
  FROM events)"""


def run(start, spark, name: str) -> str:
    """Path of a stream's log after it has read everything."""
    target = new_path(spark, name)
    start(target, new_path(spark, f"{name}-checkpoint")).awaitTermination()
    return target


@query("stream_upsert", EV + """
--
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, fips, max(event_id) AS event_id, max_by(mean, event_id) AS mean
FROM ev GROUP BY ALL""")
def stream_upsert(spark, sf):
    rows = events(spark, sf).select(F.to_date("ts").alias("date"), "fips", "event_id", "mean")
    target = run(lambda t, c: streams.stream_upsert(rows, t, c, ["date", "fips"], ["event_id"]), spark, "upsert")
    return streams.read_upserted(spark, target, ["date", "fips"], ["event_id"], by_arrival=False)


@query("stream_dedup", EV + """
--
SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, fips FROM ev""")
def stream_dedup(spark, sf):
    rows = events(spark, sf).withColumn("date", F.to_date("ts"))
    return streams.read_distinct(spark, run(
        lambda t, c: streams.stream_dedup(rows, t, c, ["date", "fips"]), spark, "dedup"))


def readings(spark, sf):
    """Masked season pixels as a stream of county rows; names join the reduced weeks."""
    lines = read_stream(spark, sf, "lineitem")
    day = F.month("l_shipdate").between(5, 10) & (F.col("l_returnflag") != "A")
    eto, pr = F.col("l_extendedprice") / 7000.0, F.greatest(F.lit(0), F.col("l_orderkey") % 40 - 20) / 2.0
    return lines.filter(day).select(
        F.col("l_shipdate").cast("timestamp").alias("ts"), d.county_code(F.col("l_suppkey")).alias("fips"),
        (F.col("l_discount") * 10).alias("ndvi_mean"), F.col("l_quantity").alias("lst_mean"),
        (F.col("l_tax") * 50).alias("vpd_mean"), eto.alias("eto_mean"), pr.alias("pr_mean"),
        (eto - pr).alias("water_deficit_mean"))


WEEKS = f"""
wk AS (SELECT year(date) AS year, {week_of('date')} AS week_of_season,
  make_date(year(date), 5, 1) + CAST(7 * ({week_of('date')} - 1) AS INTEGER) AS week_start, fips, county_name,
  ndvi, lst, vpd, eto, pr FROM px WHERE crop_class = 1 AND month(date) BETWEEN 5 AND 10),
sw AS (SELECT week_start, year, week_of_season, fips, county_name, avg(ndvi) AS ndvi_mean, avg(lst) AS lst_mean,
  avg(vpd) AS vpd_mean, avg(eto) AS eto_mean, avg(pr) AS pr_mean, avg(eto - pr) AS water_deficit_mean,
  sum(pr) AS pr_sum, sum(eto) AS eto_sum, week_start = (SELECT max(week_start) FROM wk) AS open FROM wk GROUP BY ALL)"""


def _weekly_log(spark, sf) -> str:
    return run(lambda t, c: streams.stream_weekly(readings(spark, sf), t, c), spark, "weekly-stream")


@query("stream_weekly", WEEKS + f"""
--
SELECT CAST(week_start AS VARCHAR) AS week_start, year, week_of_season, fips, open, {r6s(
    'ndvi_mean', 'lst_mean', 'vpd_mean', 'eto_mean', 'water_deficit_mean', 'pr_sum', 'eto_sum')} FROM sw""")
def stream_weekly(spark, sf):
    return streams.read_weekly(spark, _weekly_log(spark, sf)).drop("pr_mean")


@query("stream_score", WEEKS + f""",
sp AS (SELECT *, {clamp('(water_deficit_mean / 6e0 * 100)')} AS a, {clamp('((1 - pr_sum / 7e0 / 4e0) * 100)')} AS b,
  {clamp('(eto_sum / 7e0 / 8e0 * 100)')} AS c, least(100e0, {LST_RAW}) AS e, {clamp('(vpd_mean / 3e0 * 100)')} AS f FROM sw),
sx AS (SELECT *, {weighted([('0.4e0', 'a'), ('0.35e0', 'b'), ('0.25e0', 'c')])} AS water,
  {weighted([('0.6e0', 'e'), ('0.4e0', 'f')])} AS heat FROM sp)
--
SELECT CAST(week_start AS VARCHAR) AS week_start, fips, {half_up('water')} AS water, {status('round(water, 8)')} AS water_status,
  {half_up('heat')} AS heat, {status('round(heat, 8)')} AS heat_status FROM sx""")
def stream_score(spark, sf):
    """The closed weeks as the stream scored them, and the open ones as they stand."""
    names = d.county_names(spark, sf)
    scored = spark.read.parquet(run(lambda t, c: streams.stream_score(readings(spark, sf), t, c, names), spark, "score-stream"))
    weeks = streams.read_scores(spark, _weekly_log(spark, sf), names)
    rest = weeks.join(scored, ["fips", "week_start"], "left_anti")
    return scored.unionByName(rest).select(
        "week_start", "fips", F.col("water_stress_index.value").alias("water"),
        F.col("water_stress_index.status").alias("water_status"), F.col("heat_stress_index.value").alias("heat"),
        F.col("heat_stress_index.status").alias("heat_status"))


@query("stream_closed_weeks", WEEKS + f"""
--
SELECT CAST(week_start AS VARCHAR) AS week_start, year, week_of_season, fips, open, {r6s(
    'ndvi_mean', 'lst_mean', 'vpd_mean', 'eto_mean', 'water_deficit_mean', 'pr_sum', 'eto_sum')} FROM sw WHERE NOT open""")
def stream_closed_weeks(spark, sf):
    """Weeks that left the state of the stream; all but the newest one."""
    return streams.read_closed(spark, _weekly_log(spark, sf)).drop("pr_mean")


@query("stream_freshness", EV + """,
seen AS (SELECT fips, max(CAST(ts AS DATE)) AS last_seen FROM ev GROUP BY fips)
--
SELECT fips, CAST(last_seen AS VARCHAR) AS last_seen, (SELECT max(last_seen) FROM seen) - last_seen AS age_days,
  (SELECT max(last_seen) FROM seen) - last_seen > 2 AS stale FROM seen""")
def stream_freshness(spark, sf):
    target = run(lambda t, c: streams.stream_freshness(events(spark, sf), t, c), spark, "freshness")
    return streams.read_freshness(spark, target, limit_days=2)


@query("stream_freshness_alerts", EV + """,
days AS (SELECT DISTINCT fips, CAST(ts AS DATE) AS day FROM ev),
wm AS (SELECT max(day) - 1 AS now FROM days),
gaps AS (SELECT fips, day, lag(day) OVER w AS prev, lead(day) OVER w AS next FROM days WHERE day <= (SELECT now FROM wm)
  WINDOW w AS (PARTITION BY fips ORDER BY day)),
told AS (
  SELECT fips, 'silent' AS event, prev AS last_seen, prev + 3 AS day FROM gaps WHERE day - prev > 2
  UNION ALL SELECT fips, 'back', prev, day FROM gaps WHERE day - prev > 2
  UNION ALL SELECT fips, 'silent', day, day + 3 FROM gaps WHERE next IS NULL AND (SELECT now FROM wm) - day > 2)
--
SELECT fips, event, CAST(last_seen AS VARCHAR) AS last_seen, CAST(day AS VARCHAR) AS day FROM told""")
def stream_freshness_alerts(spark, sf):
    """Alerts and returns as the stream wrote them."""
    target = run(lambda t, c: alerts.stream_alerts(events(spark, sf), t, c, limit_days=2), spark, "alerts")
    return spark.read.schema(alerts.OUTPUT).parquet(target)
