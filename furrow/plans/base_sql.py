"""The domain tables as DuckDB SQL over the driver's tables, for the oracle side."""

from __future__ import annotations

NAMES = ("ndvi", "lst", "vpd", "eto", "pr")
ALL = (*NAMES, "water_deficit")
KEYS = "year, week_of_season, fips, county_name"


def r6(expr: str) -> str:
    """Six digits, half up in decimal arithmetic, as the queries present doubles."""
    return f"CAST(round(CAST({expr} AS DECIMAL(30, 9)), 6) AS DOUBLE)"


def r6s(*names: str) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


def r9(expr: str) -> str:
    """Stored precision of the weekly table."""
    return f"(round({expr}, 9) + 0e0)"


def half_up(expr: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(24, 8)), {digits}) AS DOUBLE)"


def clamp(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN NULL ELSE greatest(0e0, least(100e0, {expr})) END"


def status(expr: str) -> str:
    return (f"CASE WHEN {expr} < 20 THEN 'healthy' WHEN {expr} < 40 THEN 'mild' "
            f"WHEN {expr} < 60 THEN 'moderate' WHEN {expr} < 80 THEN 'severe' ELSE 'critical' END")


def weighted(parts: list[tuple[str, str]]) -> str:
    top = " + ".join(f"coalesce({v} * {w}, 0e0)" for w, v in parts)
    bottom = " + ".join(f"(CASE WHEN {v} IS NULL THEN 0e0 ELSE {w} END)" for w, v in parts)
    return f"coalesce(({top}) / nullif({bottom}, 0e0), 0e0)"


def week_of(day: str) -> str:
    return f"CAST(floor(({day} - make_date(year({day}), 5, 1)) / 7e0) + 1 AS BIGINT)"


PX = """
SELECT CAST(l_shipdate AS DATE) AS date, CAST(19000 + s_suppkey AS VARCHAR) AS fips, s_name AS county_name,
  s_nationkey AS nation, l_orderkey, l_linenumber, l_suppkey,
  (l_partkey % 680) / 100e0 - 96.8e0 AS lon, (l_orderkey % 330) / 100e0 + 40.2e0 AS lat,
  CASE WHEN l_returnflag = 'A' THEN 5 ELSE 1 END AS crop_class,
  l_discount * 10 AS ndvi, l_quantity AS lst, l_tax * 50 AS vpd, l_extendedprice / 7000e0 AS eto,
  greatest(0, (l_orderkey % 40) - 20) / 2e0 AS pr
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""

OBS = (
    "SELECT date, fips, min(county_name) AS county_name, "
    + ", ".join(f"avg({n}) AS {n}_mean, stddev_pop({n}) AS {n}_std, "
                f"min({n}) AS {n}_min, max({n}) AS {n}_max" for n in NAMES)
    + ", max(year(date)) AS mask_year"
    + " FROM px WHERE crop_class = 1 AND month(date) BETWEEN 5 AND 10 GROUP BY date, fips")

OBSD = "SELECT *, eto_mean - pr_mean AS water_deficit_mean, 0e0 AS water_deficit_std FROM obs"

DIM = "SELECT fips, max_by(county_name, date) AS county_name FROM obs GROUP BY fips"

SPAN = """SELECT make_date(min(year(date)), 5, 1) AS first_day, make_date(max(year(date)), 10, 31) AS last_day FROM obs"""

GRID = f"""
SELECT d AS date, fips, county_name, year(d) AS year, month(d) AS month, dayofyear(d) AS doy,
  {week_of('d')} AS week_of_season
FROM dim CROSS JOIN (SELECT CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS d FROM span)
WHERE month(d) BETWEEN 5 AND 10"""

DAILY = (
    "SELECT g.*, " + ", ".join(f"o.{n}_{s}" for n in ALL for s in ("mean", "std"))
    + " FROM grid g LEFT JOIN obsd o ON g.date = o.date AND g.fips = o.fips")


def weekly_sql(source: str) -> str:
    return (
        f"SELECT make_date(year, 5, 1) + CAST(7 * (week_of_season - 1) AS INTEGER) AS week_start, {KEYS}, "
        + ", ".join(f"{r9(f'avg({n}_mean)')} AS {n}_mean, {r9(f'sqrt(avg({n}_std * {n}_std))')} AS {n}_std" for n in ALL)
        + f", {r9('sum(pr_mean)')} AS pr_sum, {r9('sum(eto_mean)')} AS eto_sum"
        + f", {r9('sum(water_deficit_mean)')} AS water_deficit_sum"
        + ", min(ndvi_mean) AS ndvi_min, max(ndvi_mean) AS ndvi_max, max(lst_mean) AS lst_max, max(vpd_mean) AS vpd_max"
        + ", count(*) FILTER (WHERE lst_mean > 32) AS lst_days_above_32"
        + f" FROM {source} GROUP BY {KEYS}")


LST_RAW = ("CASE WHEN lst_mean < 25 THEN (25 - lst_mean) * 2 WHEN lst_mean <= 32 THEN 0e0 "
           "WHEN lst_mean <= 38 THEN (lst_mean - 32) * 15 "
           "WHEN lst_mean > 38 THEN least(100e0, 90 + (lst_mean - 38) * 5) END")

PARTS = f"""
SELECT *,
  {clamp('(water_deficit_mean / 6e0 * 100)')} AS s_def,
  {clamp('((1 - pr_sum / 7e0 / 4e0) * 100)')} AS s_rain,
  {clamp('(eto_sum / 7e0 / 8e0 * 100)')} AS s_dem,
  {LST_RAW} AS s_lst_raw,
  CASE WHEN lst_mean IS NULL THEN NULL ELSE least(100e0, {LST_RAW}) END AS s_lst,
  {clamp('(vpd_mean / 3e0 * 100)')} AS s_vpd,
  {clamp('(eto_mean / 10e0 * 100)')} AS s_eto
FROM weekly"""

IDX = f"""
SELECT *, {weighted([('0.4e0', 's_def'), ('0.35e0', 's_rain'), ('0.25e0', 's_dem')])} AS water,
  {weighted([('0.6e0', 's_lst'), ('0.4e0', 's_vpd')])} AS heat,
  CASE WHEN ndvi_mean IS NULL THEN 0e0 WHEN ndvi_mean < 0.3e0 THEN 100e0
       WHEN ndvi_mean < 0.5e0 THEN 70 - (ndvi_mean - 0.3e0) / 0.2e0 * 25
       WHEN ndvi_mean < 0.7e0 THEN 30 - (ndvi_mean - 0.5e0) / 0.2e0 * 20
       ELSE greatest(0e0, 10 - (ndvi_mean - 0.7e0) / 0.23e0 * 10) END AS vegetation,
  {weighted([('0.5e0', 's_vpd'), ('0.5e0', 's_eto')])} AS atmosphere
FROM parts"""

OVERALL = f"""
SELECT *, {clamp('(water * 0.4e0 + heat * 0.3e0 + vegetation * 0.2e0 + atmosphere * 0.1e0)')} AS overall FROM idx"""

SCORED = f"""
SELECT fips, county_name, year, week_start, week_start + 6 AS week_end, week_of_season,
  {half_up('overall')} AS overall_stress_index, {status('overall')} AS overall_status,
  {half_up('water')} AS water_value, {status('water')} AS water_status,
  CASE WHEN s_def > 60 THEN 'High water deficit' WHEN s_rain > 60 THEN 'Low precipitation'
       ELSE 'Moderate water stress across indicators' END AS water_key_driver,
  {half_up('heat')} AS heat_value, {status('heat')} AS heat_status,
  CASE WHEN s_lst_raw > 50 THEN format('High temperature ({{:.1f}}°C)', {half_up('lst_mean', 1)})
       WHEN s_vpd > 50 THEN 'High atmospheric dryness' ELSE 'Moderate heat stress' END AS heat_key_driver,
  {half_up('vegetation')} AS vegetation_value, {status('vegetation')} AS vegetation_status,
  CASE WHEN ndvi_mean IS NULL THEN 'No NDVI data'
       ELSE format('NDVI {{:.3f}} (vegetation vigor)', {half_up('ndvi_mean', 3)}) END AS vegetation_key_driver,
  {half_up('atmosphere')} AS atmosphere_value, {status('atmosphere')} AS atmosphere_status,
  'Atmospheric evaporative demand' AS atmosphere_key_driver,
  water, heat, vegetation, atmosphere, overall,
  coalesce(water_deficit_mean, 0e0) AS i_deficit, coalesce(pr_mean, 0e0) AS i_pr, coalesce(lst_mean, 0e0) AS i_lst,
  coalesce(vpd_mean, 0e0) AS i_vpd, coalesce(eto_mean, 0e0) AS i_eto, coalesce(ndvi_mean, 0e0) AS i_ndvi,
  lst_days_above_32, pr_sum
FROM allidx"""

YEARS = """
SELECT CAST(y AS BIGINT) AS year, CAST(19000 + s_suppkey AS VARCHAR) AS fips, s_name AS county,
  CAST(120 + (s_suppkey * 37 + y * 11) % 100 AS DOUBLE) AS yield_bu_per_acre
FROM supplier CROSS JOIN (SELECT unnest(generate_series(year(first_day), year(last_day))) AS y FROM span)"""

BASE = {
    "px": PX, "obs": OBS, "obsd": OBSD, "dim": DIM, "span": SPAN, "grid": GRID, "daily": DAILY,
    "weekly": weekly_sql("daily"), "parts": PARTS, "idx": IDX, "allidx": OVERALL, "scored": SCORED,
    "yields": YEARS,
}


def with_base(sql: str) -> str:
    """The query behind the base tables; ``sql`` may open with further ``name AS (...)`` tables.

    Extra tables come first and end at a line holding only ``--``.
    """
    extra, _, body = sql.rpartition("\n--\n")
    tables = ",\n".join(f"{name} AS ({text})" for name, text in BASE.items())
    more = f",\n{extra.strip()}" if extra.strip() else ""
    recursive = "RECURSIVE " if "-- recursive" in more else ""
    return f"WITH {recursive}{tables}{more}\n{body.strip()}"
