"""Grid, fills, joins, windows and incremental loads on small frames."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from furrow.functions.calendar import with_calendar
from furrow.operators import fill, forecast, grid, joins, model, quality, rollup, stress, windows
from furrow.plans import all_queries
from furrow.plans.registry import QUERIES
from furrow.session import new_path
from furrow.sources import increments, readers, rescale, writers


all_queries()


def day(text):
    return dt.date.fromisoformat(text)


def test_grid_size_and_last_week(spark):
    counties = spark.createDataFrame([("19001", "Adair"), ("19003", "Adams")], "fips string, county_name string")
    g = grid.season_grid(counties, 2016, 2025)
    assert g.count() == 184 * 10 * 2
    assert g.filter("week_of_season = 27").groupBy("fips", "year").count().select("count").distinct().first()[0] == 2
    assert g.select("year", "week_of_season", "fips").distinct().count() == 27 * 10 * 2


def test_last_name_wins(spark):
    df = spark.createDataFrame([(day("2020-05-01"), "1", "old"), (day("2020-06-01"), "1", "new")],
                               "date date, fips string, county_name string")
    assert grid.county_dim(df).first()["county_name"] == "new"


def test_zonal_stats_example(spark):
    rows = [(day("2024-07-01"), "1", "A", c, v) for c, v in
            [(1, 0.7), (1, 0.75), (1, 0.8), (1, 0.72), (1, 0.68), (5, 0.1)]]
    df = spark.createDataFrame(rows, "date date, fips string, county_name string, crop_class int, ndvi double")
    r = grid.zonal_stats(df, "ndvi").first()
    assert r["mean"] == pytest.approx(0.73) and r["min"] == 0.68 and r["max"] == 0.8
    assert r["std"] == pytest.approx((0.0088 / 5) ** 0.5)  # population form


def gaps(spark):
    values = {"2024-05-01": 1.0, "2024-05-04": 4.0, "2024-05-20": 9.0}
    days = [day("2024-05-01") + dt.timedelta(n) for n in range(25)]
    rows = [(d, "1", 2024, values.get(d.isoformat())) for d in days]
    return spark.createDataFrame(rows, "date date, fips string, year int, ndvi_mean double")


def test_fill_modes(spark):
    def filled(**kw):
        return [r["ndvi_mean"] for r in fill.fill(gaps(spark), **kw).orderBy("date").collect()]

    assert filled(mode="none")[1] is None
    assert filled(mode="zero")[1] == 0.0
    locf = filled(mode="locf", max_age=8)
    assert locf[2] == 1.0 and locf[10] == 4.0 and locf[11] is None and locf[24] == 9.0
    linear = filled(mode="linear")
    assert linear[1] == pytest.approx(2.0) and linear[11] == pytest.approx(4.0 + 5.0 * 8 / 16) and linear[24] is None
    with pytest.raises(ValueError):
        fill.fill(gaps(spark), mode="guess")


def test_rolled_first_equals_grid(spark):
    obs = spark.createDataFrame(
        [(day("2020-05-01"), "1", 0.5, 33.0, 1.0, 4.0, 1.0), (day("2020-05-03"), "1", 0.7, 31.0, 2.0, 6.0, 0.0),
         (day("2020-06-30"), "2", 0.6, 35.0, 3.0, 7.0, 2.0)],
        "date date, fips string, ndvi_mean double, lst_mean double, vpd_mean double, eto_mean double, pr_mean double")
    obs = grid.with_deficit(obs.withColumns({f"{n}_std": F.lit(0.5) for n in ("ndvi", "lst", "vpd", "eto", "pr")}))
    counties = spark.createDataFrame([("1", "A"), ("2", "B")], "fips string, county_name string")
    daily = grid.daily_from_wide(grid.season_grid(counties, 2020, 2020), obs)
    a = rollup.weekly(daily)
    b = rollup.weekly_from_observations(obs, counties, 2020, 2020).select(*a.columns)
    assert a.count() == 54 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_daily_merge_forms_agree(spark):
    rows = [(day("2020-05-01"), "1", "A", 0.5, 0.1), (day("2020-05-02"), "1", "A", None, None)]
    ind = spark.createDataFrame(rows, "date date, fips string, county_name string, mean double, std double")
    g = grid.season_grid(grid.county_dim(ind), 2020, 2020)
    deficit = grid.water_deficit(ind, ind)
    out = grid.daily_clean(g, {n: ind for n in ("ndvi", "lst", "vpd", "eto", "pr")}, deficit)
    first = out.orderBy("date").first()
    assert out.count() == 184 and first["ndvi_mean"] == 0.5 and first["water_deficit_mean"] == 0.0
    assert first["pr_std"] == 0.1 and first["water_deficit_std"] == 0.0


def test_null_keys_match_only_on_request(spark):
    df = spark.createDataFrame([(None, "1", "A", 1.0, 0.0)], "date date, fips string, county_name string, mean double, std double")
    assert grid.water_deficit(df, df).count() == 0
    assert grid.water_deficit(df, df, null_keys=True).count() == 1


def test_asof_mask(spark):
    obs = spark.createDataFrame([(day(f"{y}-06-01"),) for y in (2009, 2010, 2013, 2025)], "date date")
    masks = spark.createDataFrame([(2008,), (2010,), (2012,), (2024,), (2024,)], "mask_year int")
    got = {r["date"].year: r["mask_year"] for r in joins.asof_mask(obs, masks).collect()}
    assert got == {2010: 2010, 2013: 2012, 2025: 2024}


def test_range_join_edges(spark):
    points = spark.createDataFrame([(x,) for x in (99.9, 100.0, 119.9, 120.0, 1200.0, 1349.0, 5000.0)], "x double")
    spans = spark.createDataFrame([("VE", 100.0, 120.0), ("VT", 1100.0, 1200.0), ("R1", 1200.0, 1350.0)],
                                  "stage string, low double, high double")
    got = {r["x"]: r["stage"] for r in joins.range_join(points, spans, "x", "low", "high", 50.0).collect()}
    assert got == {99.9: None, 100.0: "VE", 119.9: "VE", 120.0: None, 1200.0: "R1", 1349.0: "R1", 5000.0: None}


def weeks(spark, specs):
    rows = [(f, "C" + f, y, w, day(f"{y}-05-01") + dt.timedelta(7 * (w - 1)), v) for f, y, w, v in specs]
    return spark.createDataFrame(
        rows, "fips string, county_name string, year int, week_of_season int, week_start date, overall_stress_index double")


def test_nearest_week_ties_and_defaults(spark):
    scored = weeks(spark, [("1", 2020, w, float(w)) for w in (25, 26, 27)] + [("1", 2021, w, float(w)) for w in (3, 7)])
    req = spark.createDataFrame([(1, "1", 5), (2, "1", 7), (3, "1", None), (4, "1", 0), (5, "1", 99), (6, "2", 5)],
                                "request_id int, fips string, week int")
    got = {r["request_id"]: (r["year"], r["week_of_season"]) for r in joins.nearest_week(req, scored).collect()}
    assert got == {1: (2021, 3), 2: (2021, 7), 3: (2020, 27), 4: (2020, 27), 5: (2020, 27), 6: (None, None)}
    same = {r["request_id"]: r["week_of_season"] for r in joins.nearest_week(req, scored, same_season=True).collect()}
    assert same[3] == 7 and same[5] == 7


def test_county_week(spark):
    scored = weeks(spark, [("1", 2020, 1, 1.0), ("1", 2020, 2, 2.0)])
    req = spark.createDataFrame([(1, "1", day("2020-05-02")), (2, "1", day("2020-05-01")), (3, "1", day("2020-05-09"))],
                                "request_id int, fips string, day date")
    got = {r["request_id"]: (r["found"], r["week_of_season"]) for r in joins.county_week(req, scored).collect()}
    assert got == {1: (True, 2), 2: (True, 1), 3: (False, None)}


def test_latest_week_takes_first_present(spark):
    df = weeks(spark, [("1", 2020, 2, None), ("1", 2020, 1, 5.0)])
    assert joins.latest_week(df).count() == 1
    assert joins.latest_week(df).first()["overall_stress_index"] is None


def test_upsert_keeps_last_and_null_values(spark):
    old = spark.createDataFrame([(day("2020-05-01"), "1", 1.0, 0), (day("2020-05-02"), "1", 2.0, 1)],
                                "date date, fips string, mean double, seq int")
    new = spark.createDataFrame([(day("2020-05-02"), "1", 3.0, 0), (day("2020-05-02"), "1", None, 1)],
                                "date date, fips string, mean double, seq int")
    got = {r["date"].day: r["mean"] for r in increments.upsert(old, new, ["date", "fips"], ["seq"]).collect()}
    assert got == {1: 1.0, 2: None}


def test_next_start(spark):
    df = spark.createDataFrame([(day("2024-10-30"),)], "date date")
    r = increments.next_start(df, "2016-05-01", F.lit("2024-10-30").cast("date")).first()
    assert str(r["start_date"]) == "2024-10-31" and r["up_to_date"]
    empty = increments.next_start(df.limit(0), "2016-05-01", F.lit("2024-10-30").cast("date")).first()
    assert str(empty["start_date"]) == "2016-05-01" and not empty["up_to_date"]


def test_rescale(spark):
    df = spark.createDataFrame([(15000.0, 50.0, 14000.0, 16000.0)], "mean double, std double, min double, max double")
    r = rescale.rescale(df, "lst").first()
    assert r["mean"] == pytest.approx(26.85) and r["std"] == pytest.approx(1.0)
    assert rescale.rescale(df, "lst", shift_std=True).first()["std"] == pytest.approx(1.0 - 273.15)
    assert rescale.rescale(df, "ndvi").first()["max"] == pytest.approx(1.6)
    assert rescale.rescale(df, "vpd").first()["mean"] == 15000.0


def test_yield_records(spark):
    records = [{"year": "2020", "county_code": "1", "Value": "181.5"}, {"year": "2020", "county_code": "153", "Value": "1,234"},
               {"year": "2020", "county_code": "3", "Value": ""}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "record string")
    got = [(r["fips"], r["yield_bu_per_acre"], r["state"]) for r in readers.parse_yield_records(df).collect()]
    assert got == [("19001", 181.5, "IOWA"), ("19153", None, "IOWA"), ("19003", None, "IOWA")]


def test_geojson_collection_and_documents(spark, tmp_path):
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"GEOID": "19001", "NAME": "Adair"}},
        {"type": "Feature", "properties": {"GEOID": " ", "fips": "19003", "county_name": "Adams"}}]}, indent=1))
    got = {(r["fips"], r["county_name"]) for r in readers.read_counties(spark, str(tmp_path / "c.geojson")).collect()}
    assert got == {("19001", "Adair"), ("19003", "Adams")}
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("one\ntwo")
    (docs / "b.md").write_text("three")
    (docs / "c.pdf").write_text("skipped")
    got = {(r["source"], r["file_type"], r["text"]) for r in readers.read_documents(spark, str(docs)).collect()}
    assert got == {("a.txt", ".txt", "one\ntwo"), ("b.md", ".md", "three")}


def test_write_increment_replaces_only_its_partitions(spark):
    path = new_path(spark, "inc")
    df = spark.createDataFrame([("1", 2020, 1.0), ("1", 2021, 2.0)], "fips string, year int, v double")
    writers.write_table(df, path)
    writers.write_table(df.filter("year = 2021").withColumn("v", F.lit(9.0)), path, increment=True)
    assert {(r["year"], r["v"]) for r in spark.read.parquet(path).collect()} == {(2020, 1.0), (2021, 9.0)}


def test_nan_is_null(spark):
    path = new_path(spark, "nan")
    df = spark.createDataFrame([(day("2020-05-01"), "1", "A", float("nan"), 0.0, 0.0, 0.0, 2020)],
                               "date date, fips string, county_name string, mean double, std double, min double, max double, mask_year int")
    df.write.parquet(path)
    assert readers.read_indicator(spark, path).first()["mean"] is None


def test_gap_and_spells(spark):
    df = spark.createDataFrame([(day(d), "1", 2024) for d in ("2024-05-01", "2024-05-02", "2024-05-03", "2024-05-10")],
                               "date date, fips string, year int")
    assert windows.max_gap(df).first()["max_gap_days"] == 7
    dry = [(day("2024-07-01") + dt.timedelta(n), "1", 2024, 3.0 if n == 8 else 0.0) for n in range(15)]
    rain = spark.createDataFrame(dry, "date date, fips string, year int, pr_mean double")
    got = [(r["days"], r["first_day"].day) for r in windows.spells(rain, F.col("pr_mean") < 2).collect()]
    assert got == [(8, 1)]


def test_trend_percentile_anomaly(spark):
    df = weeks(spark, [("1", 2020, 1, 50.0), ("1", 2020, 2, 52.0), ("1", 2020, 3, 60.0), ("1", 2020, 4, 40.0)])
    got = [r["trend"] for r in windows.with_trend(df).orderBy("week_start").collect()]
    assert got == [None, "stable", "declining", "improving"]
    years = weeks(spark, [("1", y, 1, float(v)) for y, v in ((2018, 10), (2019, 30), (2020, 20))])
    got = {r["year"]: r["historical_percentile"] for r in windows.with_percentile(years).collect()}
    assert got == {2018: 0.0, 2019: 100.0, 2020: 50.0}
    z = windows.with_anomaly(years, windows.week_normals(years), "overall_stress_index", "index_mean", "index_std")
    assert {r["year"]: r["anomaly"] for r in z.collect()} == {2018: -1.0, 2019: 1.0, 2020: 0.0}
    flat = weeks(spark, [("1", 2020, 1, 5.0), ("1", 2021, 1, 5.0)])
    z = windows.with_anomaly(flat, windows.week_normals(flat), "overall_stress_index", "index_mean", "index_std")
    assert all(r["anomaly"] is None for r in z.collect())


def test_driver_ties_keep_order(spark):
    df = spark.createDataFrame([(10.0, 10.0, 10.0, 10.0), (0.0, 5.0, 5.0, 9.0)],
                               "water double, heat double, vegetation double, atmosphere double")
    got = [(r["primary_driver"], r["secondary_driver"]) for r in stress.with_drivers(df).collect()]
    assert got == [("Water stress", "Heat stress"), ("Atmospheric stress", "Heat stress")]


def test_critical_period(spark):
    rows = [("1", 2023, d, x, 30.0) for d, x in ((195, 5.0), (200, 6.0), (220, 4.0), (230, 3.0))]
    df = spark.createDataFrame(rows, "fips string, year int, doy int, water_deficit_mean double, lst_mean double")
    assert rollup.critical_period(df).first()["critical_deficit"] == 10.0


def test_health_index_weights(spark):
    df = spark.createDataFrame([(8, 0.75, 25.0, 1.0, 0.0), (23, 0.75, 25.0, 1.0, 0.0), (9, 0.0, None, 1.0, 0.0)],
                               "week_of_season int, ndvi_mean double, lst_mean double, vpd_mean double, water_deficit_mean double")
    got = [r["health_index"] for r in stress.health_index(df).collect()]
    assert got[0] == pytest.approx(0.3 * 90 + 0.2 * 89 + 0.2 * 89 + 0.3 * 89) and got[1] is None and got[2] is None


def test_running_features_fill_weeks(spark):
    rec = spark.createDataFrame([("1", w, 1.0, 2, 0.5, 1.0, 3.0) for w in (1, 2, 5)],
                                "fips string, week int, water_deficit_mean double, lst_days_above_32C int, ndvi_mean double, vpd_mean double, pr_sum double")
    got = {r["current_week"]: r["weeks_completed"] for r in forecast.running_features(rec, last_week=7).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 3, 6: 3, 7: 3}
    one = forecast.forecast(forecast.running_features(rec)).filter("current_week = 1").first()
    assert one["ndvi_std"] == 0.0
    assert one["raw_forecast"] == pytest.approx(198.7 - 1.2 * 2 - 0.8 + 0.15 * 3 + 45 * 0.5 - 15 * 0.5)


def test_interval_is_one_sided(spark):
    df = spark.createDataFrame([(10, 400.0), (10, 20.0)], "current_week int, raw_forecast double")
    high, low = forecast.with_interval(df).collect()
    assert (high["yield_forecast_bu_acre"], high["confidence_interval_lower"], high["confidence_interval_upper"]) == (300.0, 385.0, 300.0)
    assert (low["yield_forecast_bu_acre"], low["confidence_interval_lower"], low["confidence_interval_upper"]) == (50.0, 50.0, 35.0)


def test_tree_model_and_fallback(spark):
    from furrow.config import TreeGrid

    rows = [(str(i), 2015 + i % 4, i % 5, float(i % 7), float(i), 0.5 + i % 3 / 10, 0.4, 0.1, 27, 150.0 + i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "fips string, year int, heat_days long, water_deficit double, precip double, ndvi_avg double, "
                                     "ndvi_min double, ndvi_std double, weeks_completed long, yield_bu_per_acre double")
    fitted, scores = model.train(df, TreeGrid(depths=(2,), rates=(0.1,), rounds=(2,)), folds=2)
    assert {r["fold_year"] for r in scores.collect()} == {2017, 2018}
    broken = df.withColumn("ndvi_avg", F.when(F.col("fips") == "3", None).otherwise(F.col("ndvi_avg")))
    types = {r["fips"]: (r["model_type"], r["raw_forecast"]) for r in model.score_model(broken, fitted).collect()}
    assert types["3"] == ("linear", None) and types["4"][0] == "boosted trees" and types["4"][1] is not None
    assert model.importances(fitted, spark).count() == 5


def test_fits_have_no_more_parts_than_cores(spark, monkeypatch):
    from furrow.config import TreeGrid

    parts = []

    class Seen(model.GBTRegressor):
        def fit(self, dataset):
            parts.append(dataset.rdd.getNumPartitions())
            return super().fit(dataset)

    monkeypatch.setattr(model, "GBTRegressor", Seen)
    cores = spark.sparkContext.defaultParallelism
    rows = [(str(k), 2000 + k % 3, *(float(k % (n + 2)) for n in range(7)), float(k % 11)) for k in range(120)]
    names = ", ".join(f"{f} double" for f in model.FEATURES)
    df = spark.createDataFrame(rows, f"fips string, year int, {names}, yield_bu_per_acre double").repartition(3 * cores)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        model.train(df, TreeGrid(depths=(2,), rates=(0.1,), rounds=(2,)), folds=2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(parts) == 3 and max(parts) <= cores


def test_quality_checks(spark):
    df = spark.createDataFrame([(day("2024-05-01"), "1", 0.5), (day("2024-05-01"), "1", 1.5), (None, None, None), (None, None, 0.1)],
                               "date date, fips string, ndvi_mean double")
    assert quality.duplicates(df).first()["duplicates"] == 2
    r = quality.check_ranges(df, {"ndvi_mean": (0.0, 1.0)}).first()
    assert (r["out_of_range"], r["present"], r["pct"]) == (1, 3, pytest.approx(100 / 3))
    c = {r["column"]: r for r in quality.completeness(df).collect()}
    assert c["date"]["missing"] == 2 and c["ndvi_mean"]["completeness"] == pytest.approx(1 - 5 / 12)
    values = spark.createDataFrame([(float(v),) for v in [1, 2, 2.5, 3, 2.8, 100]], "x double")
    assert quality.sigma_outliers(values, "x").count() == 0
    assert quality.sigma_outliers(values, "x", 2.0).count() == 1


def test_calendar_columns(spark):
    r = with_calendar(spark.createDataFrame([(day("2024-07-15"),)], "date date")).first()
    assert (r["year"], r["month"], r["doy"], r["week_of_season"]) == (2024, 7, 197, 11)


def test_later_seasons_are_there(spark, tmp_path):
    """Pixels moved two years on are found by the grid, the weekly table, the scores and the latest answers."""
    source = "/root/testdata/sf0.001"
    supplier = spark.read.parquet(f"{source}/supplier.parquet")
    supplier.write.parquet(str(tmp_path / "supplier.parquet"))
    lines = spark.read.parquet(f"{source}/lineitem.parquet")
    shifted = lines.limit(2000).withColumn("l_shipdate", F.expr("l_shipdate + INTERVAL 2 YEARS"))
    lines.unionByName(shifted).write.parquet(str(tmp_path / "lineitem.parquet"))
    newest = shifted.agg(F.max(F.year("l_shipdate"))).first()[0]
    first = lines.agg(F.min(F.year("l_shipdate"))).first()[0]
    sf = str(tmp_path)
    years = [r[0] for r in QUERIES["season_grid"](spark, sf).select("year").distinct().orderBy("year").collect()]
    assert years == list(range(first, newest + 1)) and newest >= 2002
    for name, column in (("weekly_totals", "week_start"), ("score_week", "week_start"), ("latest_all", "week_start")):
        assert QUERIES[name](spark, sf).agg(F.max(F.col(column))).first()[0][:4] == str(newest), name


def test_nearest_week_rows_are_not_aggregated(spark):
    """Whole rows were sorted once per target; now only weeks and dates are looked at."""
    scored = weeks(spark, [("1", 2020, w, float(w)) for w in (25, 26, 27)] + [("2", 2021, 4, 1.0)])
    scored = scored.withColumn("fips", F.nullif("fips", F.lit("2")))
    table = joins.nearest_week_table(scored)
    assert "Aggregate" not in table._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["fips"], r["target_week"]): r["week_of_season"] for r in table.collect()}
    assert len(got) == 56 and got["1", 1] == 25 and got["1", None] == 27 and got[None, 27] == 4


def test_daily_table_is_joined_before_its_days_are_made(spark):
    """The rows of the join by day, with null and repeated keys; nothing of the grid's size is shuffled."""
    names = [f"{n}_{s}" for n in grid.INDICATORS for s in ("mean", "std")]
    rows = [(dt.date(2020, 6, 1), "19001"), (dt.date(2020, 6, 1), "19001"), (dt.date(2021, 10, 31), "19001"), (None, "19001"),
            (dt.date(2020, 1, 5), "19001"), (dt.date(2020, 5, 1), None), (dt.date(2019, 7, 1), "19003"), (dt.date(2020, 7, 1), "19009")]
    wide = spark.createDataFrame([(d, f, *[float(k + n) if n % 3 else None for n in range(len(names))]) for k, (d, f) in enumerate(rows)],
                                 "date date, fips string, " + ", ".join(f"{n} double" for n in names))
    counties = spark.createDataFrame([("19001", "a"), ("19003", "b"), (None, "c"), ("19005", None)], "fips string, county_name string")
    want = grid.daily_from_wide(grid.season_grid(counties, 2020, 2021), wide)
    got = grid.daily_by_season(counties, 2020, 2021, wide)
    assert got.dtypes == want.dtypes and got.count() == want.count() == 4 * 2 * 184 + 1
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

    made = got.filter("week_of_season > 3").groupBy("fips", "year", "week_of_season").count()
    plan = made._jdf.queryExecution().executedPlan().toString().splitlines()
    days = next(k for k, line in enumerate(plan) if "Generate inline" in line)
    assert not any("Exchange" in line for line in plan[:days])  # the days are made above the last shuffle
