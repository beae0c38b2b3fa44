"""Band edges and worked examples of the column expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from furrow.functions import bands, calendar, scalars, stress
from furrow.operators import forecast, rollup

L = F.lit


def none():
    return F.lit(None).cast("double")


@pytest.mark.parametrize("index, label", [
    (0.0, "healthy"), (19.99, "healthy"), (20.0, "mild"), (40.0, "moderate"), (60.0, "severe"), (79.9, "severe"),
    (80.0, "critical"), (100.0, "critical")])
def test_status_edges(one, index, label):
    assert one(bands.stress_status(L(index))) == label


@pytest.mark.parametrize("celsius, score", [
    (20.0, 10.0), (25.0, 0.0), (32.0, 0.0), (34.0, 30.0), (38.0, 90.0), (39.0, 95.0), (45.0, 100.0), (-40.0, 100.0)])
def test_heat_score(one, celsius, score):
    assert one(stress.surface_heat_score(L(celsius))) == pytest.approx(score)


@pytest.mark.parametrize("ndvi, score", [
    (0.29, 100.0), (0.3, 70.0), (0.375, 60.625), (0.5, 30.0), (0.7, 10.0), (0.93, 0.0), (1.0, 0.0)])
def test_vegetation(one, ndvi, score):
    assert one(stress.vegetation_index(L(ndvi))) == pytest.approx(score)


def test_missing_parts_renormalise(one):
    only_rain = stress.water_index(none(), L(0.0), none())
    assert one(only_rain) == pytest.approx(100.0)
    deficit_and_demand = stress.water_index(L(3.0), none(), L(28.0))
    assert one(deficit_and_demand) == pytest.approx((0.4 * 50 + 0.25 * 50) / 0.65)
    assert one(stress.water_index(none(), none(), none())) == 0.0
    assert one(stress.heat_index(none(), L(1.5))) == pytest.approx(50.0)
    assert one(stress.vegetation_index(none())) == 0.0


def test_composite_example(one):
    assert one(stress.composite_index(L(50.0), L(40.0), L(35.0), L(30.0))) == pytest.approx(42.0)
    assert one(stress.composite_index(L(100.0), L(100.0), L(100.0), L(100.0))) == pytest.approx(100.0)


def test_advice(one):
    def advice(water, heat, vegetation, overall, week):
        return one(stress.recommendations(L(overall), L(water), L(heat), L(vegetation), L(week)))

    assert len(advice(71.0, 0.0, 0.0, 0.0, 5)) == 2
    assert advice(0.0, 75.0, 0.0, 0.0, 9)[0].startswith("🌡️")
    # heat above 70 outside pollination adds nothing, so the favourable line remains
    assert advice(0.0, 75.0, 0.0, 0.0, 12)[0].startswith("✅")
    assert advice(0.0, 60.0, 0.0, 0.0, 12)[0].startswith("⚠️  High temp")
    assert len(advice(80.0, 60.0, 65.0, 75.0, 9)) == 6


def test_key_driver_texts(one):
    assert one(stress.water_driver(L(5.0), L(0.0))) == "High water deficit"
    assert one(stress.water_driver(L(1.0), L(0.0))) == "Low precipitation"
    assert one(stress.water_driver(none(), none())).startswith("Moderate")
    assert one(stress.heat_driver(L(36.04), L(0.0))) == "High temperature (36.0°C)"
    assert one(stress.heat_driver(L(30.0), L(2.0))) == "High atmospheric dryness"
    # the uncapped cold score counts too
    assert one(stress.heat_driver(L(-5.0), L(0.0))).startswith("High temperature")
    assert one(stress.vegetation_driver(L(0.375))) == "NDVI 0.375 (vegetation vigor)"
    assert one(stress.vegetation_driver(none())) == "No NDVI data"


@pytest.mark.parametrize("mm, label", [(0.0, "dry"), (5.0, "light"), (15.0, "moderate"), (25.0, "heavy"),
                                       (50.0, "very heavy"), (50.1, "extreme")])
def test_rain_class(one, mm, label):
    assert one(bands.rain_class(L(mm))) == label


@pytest.mark.parametrize("eto, pr, band", [(5, 2, "moderate"), (7, 1, "high"), (4, 15, "surplus"), (8, 0, "severe")])
def test_deficit_examples(one, eto, pr, band):
    assert one(bands.deficit_band(L(float(eto - pr)))) == band


def test_steps_and_bands(one):
    assert [one(bands.deficit_step(L(x))) for x in (-1.0, 0.0, 2.0, 4.0, 6.0)] == [0, 20, 50, 75, 100]
    assert one(bands.ndvi_ratio_step(L(0.72), L(0.80))) == 50
    assert one(bands.ndvi_ratio_step(L(0.72), L(0.0))) is None
    assert [one(bands.anomaly_class(L(z))) for z in (0.5, -1.0, 2.0, -2.1)] == ["normal", "mild", "moderate", "severe"]
    assert [one(bands.yield_band(L(y))) for y in (79.0, 80.0, 120.0, 200.0, 201.0)] == [
        "severe drought", "below typical", "typical", "typical", "excellent"]
    assert one(bands.stress_label4(none())) == "N/A"
    assert [one(bands.yield_factor(L(x))) for x in (81.0, 80.0, 40.0, 20.0, 10.0)] == [
        "100%", "90-100%", "70-90%", "50-70%", "<50%"]


@pytest.mark.parametrize("day, week", [("2024-05-01", 1), ("2024-05-07", 1), ("2024-05-08", 2), ("2024-05-15", 3),
                                       ("2023-10-30", 27), ("2023-10-31", 27), ("2023-10-29", 26)])
def test_week_of_season(one, day, week):
    assert one(calendar.week_of_season(L(day).cast("date"))) == week


def test_week_start(one):
    assert str(one(calendar.week_start(L(2024), L(27)))) == "2024-10-30"


def test_codes_and_dates(one):
    assert one(scalars.is_valid_fips(L("19153"))) and not one(scalars.is_valid_fips(L("1915")))
    assert not one(scalars.is_valid_fips(L("20001"))) and not one(scalars.is_valid_fips(F.lit(None).cast("string")))
    assert one(scalars.is_iso_date(L("2024-07-15"))) and not one(scalars.is_iso_date(L("2024-13-01")))
    assert not one(scalars.is_iso_date(L("yesterday")))


def test_half_up_ignores_noise(one):
    assert one(scalars.half_up(L(60.625))) == 60.63
    assert one(scalars.half_up(L(60.62499999999999))) == 60.63
    assert one(scalars.half_up(L(2.675))) == 2.68
    assert one(scalars.half_up(L(-2.675))) == -2.68
    assert one(scalars.half_up(none())) is None


def test_heat_units(one):
    assert one(rollup.growing_degree_days(L(30.0), L(15.0))) == 12.5
    assert one(rollup.growing_degree_days(L(95.0), L(60.0), base=50.0, cap=86.0)) == 23.0


@pytest.mark.parametrize("model, values", [("linear", [15.0, 12.0, 8.32, 5.0]), ("tree", [12.0, 8.0, 6.5, 4.0])])
def test_uncertainty_steps(one, model, values):
    assert [one(forecast.uncertainty(L(w), model)) for w in (21, 22, 30, 36)] == values
    path = [one(forecast.uncertainty(L(w), model)) for w in (22, 27, 30, 36, 40)]
    assert path == sorted(path, reverse=True)


def test_confidence(one):
    assert [one(forecast.confidence(L(w))) for w in (21, 22, 30)] == ["low", "medium", "high"]
    assert one(forecast.confidence(L(5), light=True)) == "medium"
