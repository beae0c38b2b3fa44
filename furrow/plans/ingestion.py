"""Queries over sources, sinks and the incremental loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import calendar, scalars
from furrow.operators import grid, joins
from furrow.plans import domain as d
from furrow.plans.base_sql import r6, r6s
from furrow.plans.registry import query
from furrow.session import new_path
from furrow.sources import increments, readers, rescale, writers

OBS_COLUMNS = ("date", "fips", "county_name", "mean", "std", "min", "max", "mask_year")


def obs_sql(name: str) -> str:
    return (f"SELECT CAST(date AS VARCHAR) AS date, fips, county_name, {r6(f'{name}_mean')} AS mean, "
            f"{r6(f'{name}_std')} AS std, {r6(f'{name}_min')} AS min, {r6(f'{name}_max')} AS max, mask_year FROM obs")


@query("src_indicator_parquet", obs_sql("ndvi"))
def src_indicator_parquet(spark, sf):
    path = new_path(spark, "ndvi")
    d.indicator(spark, sf, "ndvi").select(*OBS_COLUMNS).write.parquet(path)
    return readers.read_indicator(spark, path)


YIELD_CSV = """SELECT year, 'IOWA' AS state, '19' AS state_fips, county, substr(fips, 3) AS county_fips,
  yield_bu_per_acre, 'BU / ACRE' AS unit, fips FROM yields"""


def yield_table(spark, sf):
    return d.yields(spark, sf).select(
        "year", F.lit("IOWA").alias("state"), F.lit("19").alias("state_fips"), "county",
        F.substring("fips", 3, 20).alias("county_fips"), "yield_bu_per_acre",
        F.lit("BU / ACRE").alias("unit"), "fips")


@query("src_yield_csv", YIELD_CSV)
@query("sink_csv", YIELD_CSV)
def src_yield_csv(spark, sf):
    path = new_path(spark, "yields")
    writers.write_csv(yield_table(spark, sf), path)
    return readers.read_yields(spark, path)


@query("src_yield_json", """
raw AS (SELECT year, county, s_suppkey AS k, yield_bu_per_acre AS y FROM yields
  JOIN supplier ON s_name = county)
--
SELECT year, 'IOWA' AS state, '19' AS state_fips, county, CAST(k AS VARCHAR) AS county_fips,
  CASE WHEN k % 7 IN (0, 3) OR k % 7 = 5 THEN NULL ELSE y END AS yield_bu_per_acre,
  'BU / ACRE' AS unit,
  '19' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS fips
FROM raw""")
def src_yield_json(spark, sf):
    key = F.col("fips").cast("long") - 19000
    value = (F.when(key % 7 == 0, "").when(key % 7 == 3, "(D)").when(key % 7 == 5, "1,234")
             .otherwise(F.col("yield_bu_per_acre").cast("string")))
    record = F.to_json(F.struct(
        F.col("year").cast("string").alias("year"), F.col("county").alias("county_name"),
        key.cast("string").alias("county_code"), value.alias("Value")))
    return readers.parse_yield_records(d.yields(spark, sf).select(record.alias("record")))


RECORD_END = "\x1e"


@query("src_text_dir", """
SELECT lang, '.txt' AS file_type, length(text) AS characters, md5(text) AS digest FROM documents""")
def src_text_dir(spark, sf):
    # One folder per language; a record ends with its own separator, so no file is one row.
    path = new_path(spark, "texts")
    d.table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").option(
        "lineSep", RECORD_END).text(path)
    rows = readers.read_documents(spark, path, RECORD_END)
    lang = F.regexp_extract("path", r"lang=([^/]+)/", 1)
    return rows.select(lang.alias("lang"), "file_type", F.length("text").alias("characters"), F.md5("text").alias("digest"))


@query("src_weekly_by_contract", """
SELECT CAST(week_start AS VARCHAR) AS week_start, year, week_of_season, fips, county_name, lst_days_above_32, """
       + r6s("ndvi_mean", "lst_mean", "vpd_mean", "eto_mean", "water_deficit_mean", "pr_sum", "eto_sum")
       + " FROM weekly")
def src_weekly_by_contract(spark, sf):
    path = new_path(spark, "weekly")
    writers.write_table(d.weekly(spark, sf), path)
    weekly, _ = readers.read_weekly(spark, path)
    return weekly.select("week_start", "year", "week_of_season", "fips", "county_name", "ndvi_mean", "lst_mean",
                         "vpd_mean", "eto_mean", "water_deficit_mean", "pr_sum", "eto_sum", "lst_days_above_32")


@query("src_county_geojson", "SELECT CAST(19000 + s_suppkey AS VARCHAR) AS fips, s_name AS county_name FROM supplier")
def src_county_geojson(spark, sf):
    # Collections of at most 100 features, one per line; property names vary as in published files.
    key = F.col("s_suppkey")
    code = d.county_code(key)
    props = F.when(key % 2 == 0, F.create_map(F.lit("GEOID"), code, F.lit("NAME"), F.col("s_name"))).otherwise(
        F.create_map(F.lit("fips"), code, F.lit("county_name"), F.col("s_name")))
    features = d.table(spark, sf, "supplier").groupBy(F.floor(key / 100).alias("part")).agg(
        F.collect_list(F.struct(F.lit("Feature").alias("type"), props.alias("properties"))).alias("features"))
    path = new_path(spark, "geojson")
    features.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))).write.text(path)
    return readers.read_counties(spark, path, multi_line=False)


@query("coalesce_keys", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus ELSE o_orderpriority END AS first_key FROM orders""")
def coalesce_keys(spark, sf):
    orders = d.table(spark, sf, "orders")
    blanked = orders.withColumns({
        "a": F.when(F.col("o_orderstatus") == "O", F.col("o_orderstatus")).when(F.col("o_orderstatus") == "F", "  "),
        "b": F.when(F.col("o_orderstatus") == "P", F.col("o_orderstatus"))})
    return blanked.select("o_orderkey", scalars.first_present("a", "b", "o_orderpriority").alias("first_key"))


@query("season_filter", """
SELECT CAST(date AS VARCHAR) AS date, count(*) AS pixels, CAST(sum(l_linenumber) AS BIGINT) AS line_sum
FROM px WHERE month(date) BETWEEN 5 AND 10 GROUP BY 1""")
def season_filter(spark, sf):
    return calendar.in_season(d.readings(spark, sf)).groupBy("date").agg(
        F.count("*").alias("pixels"), F.sum("l_linenumber").alias("line_sum"))


@query("date_range_filter", """
SELECT l_orderkey, l_linenumber, CAST(date AS VARCHAR) AS date, fips FROM px
WHERE date >= DATE '1996-05-01' AND date < DATE '1999-10-31'""")
def date_range_filter(spark, sf):
    return calendar.between_dates(d.readings(spark, sf), "1996-05-01", "1999-10-31").select(
        "l_orderkey", "l_linenumber", "date", "fips")


@query("bbox_filter", f"""
SELECT l_orderkey, l_linenumber, {r6('lon')} AS lon, {r6('lat')} AS lat FROM px
WHERE lon >= -95.005e0 AND lon <= -91.005e0 AND lat >= 40.505e0 AND lat <= 42.505e0""")
def bbox_filter(spark, sf):
    return grid.in_bbox(d.readings(spark, sf), -95.005, 40.505, -91.005, 42.505).select(
        "l_orderkey", "l_linenumber", "lon", "lat")


@query("mask_build", """
SELECT l_orderkey, l_linenumber, CAST(crop_class = 1 AS BIGINT) AS mask FROM px""")
def mask_build(spark, sf):
    return d.readings(spark, sf).select("l_orderkey", "l_linenumber", grid.crop_mask().alias("mask"))


@query("mask_year_asof", f"""
masks AS (SELECT DISTINCT year(date) AS mask_year FROM px WHERE year(date) % 3 = 1)
--
SELECT CAST(o.date AS VARCHAR) AS date, o.fips, {r6('o.ndvi_mean')} AS mean, m.mask_year
FROM obs o ASOF JOIN masks m ON year(o.date) >= m.mask_year""")
def mask_year_asof(spark, sf):
    pixels = d.readings(spark, sf)
    masks = pixels.select(F.year("date").alias("mask_year")).filter(F.col("mask_year") % 3 == 1)
    obs = d.indicator(spark, sf, "ndvi").select("date", "fips", "mean")
    return joins.asof_mask(obs, masks, oldest=1990)


@query("zonal_stats", obs_sql("lst"))
def zonal_stats(spark, sf):
    return d.indicator(spark, sf, "lst").select(*OBS_COLUMNS)


@query("spatial_stats", f"""
SELECT nation, year(date) AS year, {r6('avg(eto)')} AS mean, {r6('stddev_pop(eto)')} AS std, {r6('min(eto)')} AS min,
  {r6('max(eto)')} AS max FROM px WHERE crop_class = 1 AND month(date) BETWEEN 5 AND 10 GROUP BY nation, year(date)""")
def spatial_stats(spark, sf):
    pixels = d.season_readings(spark, sf).withColumn("year", F.year("date"))
    return grid.area_stats(pixels, d.county_names(spark, sf).select("fips", "nation"), "eto", ("nation", "year"))


def _raw(spark, sf, name, encode):
    """Observations of the sensor's raw numbers."""
    return grid.zonal_stats(d.season_readings(spark, sf).withColumn(name, encode(F.col(name))), name, ("date", "fips"))


RAW_SQL = """
SELECT CAST(date AS VARCHAR) AS date, fips, {mean} AS mean, {std} AS std, {lo} AS min, {hi} AS max FROM (
  SELECT date, fips, avg(v) AS a, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi
  FROM (SELECT date, fips, {enc} AS v FROM px WHERE crop_class = 1 AND month(date) BETWEEN 5 AND 10)
  GROUP BY date, fips)"""


@query("rescale_ndvi", RAW_SQL.format(enc="ndvi * 10000", mean=r6("a * 0.0001e0"), std=r6("s * 0.0001e0"),
                                      lo=r6("lo * 0.0001e0"), hi=r6("hi * 0.0001e0")))
def rescale_ndvi(spark, sf):
    raw = _raw(spark, sf, "ndvi", lambda c: c * 10000)
    return rescale.rescale(raw, "ndvi")


@query("rescale_lst", RAW_SQL.format(
    enc="(lst + 273.15e0) / 0.02e0", mean=r6("a * 0.02e0 - 273.15e0"), std=r6("s * 0.02e0"),
    lo=r6("lo * 0.02e0 - 273.15e0"), hi=r6("hi * 0.02e0 - 273.15e0")))
def rescale_lst(spark, sf):
    raw = _raw(spark, sf, "lst", lambda c: (c + 273.15) / 0.02)
    return rescale.rescale(raw, "lst")


@query("rescale_vpd", RAW_SQL.format(enc="vpd * 1000", mean=r6("a / 1000e0"), std=r6("s / 1000e0"),
                                     lo=r6("lo / 1000e0"), hi=r6("hi / 1000e0")))
def rescale_vpd(spark, sf):
    raw = _raw(spark, sf, "vpd", lambda c: c * 1000)
    return rescale.rescale(raw, "vpd", vpd_divisor=1000.0)


@query("high_water_mark", """
SELECT CAST(max(date) AS VARCHAR) AS last_date, CAST(max(date) + 1 AS VARCHAR) AS start_date,
  max(date) + 1 > (SELECT last_day FROM span) AS up_to_date FROM obs""")
def high_water_mark(spark, sf):
    return increments.next_start(d.indicator(spark, sf, "pr"), "2016-05-01", d.season_end(spark, sf))


# Stored rows: all years but the last; new rows: the last two years, values shifted, so keys collide.
UPSERT = f"""
newest AS (SELECT year(last_day) AS y FROM span),
old AS (SELECT date, fips, county_name, pr_mean AS mean, 0 AS b FROM obs, newest WHERE year(date) < y),
new AS (SELECT date, fips, county_name, pr_mean + 1 AS mean, 1 AS b FROM obs, newest WHERE year(date) >= y - 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date, fips ORDER BY b DESC) AS rn
  FROM (SELECT * FROM old UNION ALL SELECT * FROM new))
--
SELECT CAST(date AS VARCHAR) AS date, fips, county_name, {r6('mean')} AS mean FROM ranked WHERE rn = 1"""


@query("incremental_upsert", UPSERT)
def incremental_upsert(spark, sf):
    """A stored table takes an increment; only the years it brings are read and written again."""
    obs = d.indicator(spark, sf, "pr").select("date", "fips", "county_name", "mean", F.year("date").alias("year"))
    newest, path = d.season_years(spark, sf)[1], new_path(spark, "increments")
    writers.write_table(obs.filter(F.col("year") < newest), path)
    fresh = obs.filter(F.col("year") >= newest - 1).withColumn("mean", F.col("mean") + 1)
    increments.upsert_table(spark, path, fresh, ["date", "fips"], ["mean"])
    return spark.read.schema(obs.schema).parquet(path).drop("year").orderBy("date", "fips")


@query("upsert_yields", """
SELECT year, fips, county, CASE WHEN year >= (SELECT year(last_day) - 2 FROM span) THEN yield_bu_per_acre + 2
  ELSE yield_bu_per_acre END AS yield_bu_per_acre FROM yields""")
def upsert_yields(spark, sf):
    harvests, newest, path = d.yields(spark, sf), d.season_years(spark, sf)[1], new_path(spark, "yields")
    writers.write_table(harvests.filter(F.col("year") < newest), path)
    fresh = harvests.filter(F.col("year") >= newest - 2).withColumn("yield_bu_per_acre", F.col("yield_bu_per_acre") + 2)
    increments.upsert_table(spark, path, fresh, ["year", "fips"], ["county"])
    return spark.read.schema(harvests.schema).parquet(path).select(*harvests.columns).orderBy("year", "county")


@query("dedupe_keep_last", """
SELECT s_name AS county_name, l_orderkey AS last_order, l_linenumber AS last_line, l_quantity AS lst
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn
  FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey WHERE rn = 1""")
def dedupe_keep_last(spark, sf):
    """The last line of every county; names join the reduced rows."""
    lines, counties = d.table(spark, sf, "lineitem"), d.table(spark, sf, "supplier")
    rows = lines.select("l_suppkey", F.col("l_orderkey").alias("last_order"), F.col("l_linenumber").alias("last_line"),
                        "l_partkey", F.col("l_quantity").alias("lst"))
    last = increments.keep_last(rows, ["l_suppkey"], ["last_order", "last_line", "l_partkey"])
    return last.join(counties, last["l_suppkey"] == counties["s_suppkey"]).select(
        F.col("s_name").alias("county_name"), "last_order", "last_line", "lst")


@query("missing_years", """
SELECT CAST(y AS BIGINT) AS year FROM (SELECT unnest(generate_series(1990, 2005)) AS y)
WHERE y NOT IN (SELECT year(date) FROM px)""")
def missing_years(spark, sf):
    return increments.missing_years(spark, d.readings(spark, sf).select(F.year("date").alias("year")), 1990, 2005)


DAILY_OUT = ("date", "fips", "county_name", "year", "month", "doy", "week_of_season", "ndvi_mean", "ndvi_std",
             "lst_mean", "lst_std", "vpd_mean", "vpd_std", "eto_mean", "eto_std", "pr_mean", "pr_std",
             "water_deficit_mean", "water_deficit_std")
DAILY_SQL = ("SELECT CAST(date AS VARCHAR) AS date, " + ", ".join(DAILY_OUT[1:7]) + ", " + r6s(*DAILY_OUT[7:])
             + " FROM {source}")


@query("sink_parquet", DAILY_SQL.format(source="daily"))
def sink_parquet(spark, sf):
    path = new_path(spark, "daily")
    daily = d.daily(spark, sf)
    writers.write_table(daily, path)
    return spark.read.schema(daily.schema).parquet(path).select(*DAILY_OUT)


@query("ingest_summary", f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE year(date) = (SELECT year(last_day) FROM span)) AS new_rows,
  CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
  count(DISTINCT fips) AS counties, {r6('avg(pr_mean)')} AS mean_value FROM obs""")
def ingest_summary(spark, sf):
    return increments.ingest_summary(d.indicator(spark, sf, "pr"), is_new=F.year("date") == d.season_years(spark, sf)[1])
