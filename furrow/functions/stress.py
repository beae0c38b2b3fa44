"""Stress scores as column expressions, 0 to 100, higher is more stress.

The thresholds, scales and message texts are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.config import STRESS_WEIGHTS, StressWeights
from furrow.functions.scalars import clamp, half_up, weighted_present


def deficit_score(deficit: Column) -> Column:
    return clamp(deficit / 6.0 * 100, source=deficit)


def rain_score(weekly_sum: Column) -> Column:
    return clamp((1 - weekly_sum / 7.0 / 4.0) * 100, source=weekly_sum)


def demand_score(weekly_sum: Column) -> Column:
    return clamp(weekly_sum / 7.0 / 8.0 * 100, source=weekly_sum)


def surface_heat_raw(celsius: Column) -> Column:
    """Uncapped heat score: cold below 25, none to 32, a ramp to 38, critical beyond."""
    return (F.when(celsius < 25, (25 - celsius) * 2)
            .when(celsius <= 32, 0.0)
            .when(celsius <= 38, (celsius - 32) * 15)
            .when(celsius > 38, F.least(F.lit(100.0), 90 + (celsius - 38) * 5)))


def surface_heat_score(celsius: Column) -> Column:
    return F.when(celsius.isNotNull(), F.least(F.lit(100.0), surface_heat_raw(celsius)))


def vpd_score(kpa: Column) -> Column:
    return clamp(kpa / 3.0 * 100, source=kpa)


def eto_score(daily: Column) -> Column:
    return clamp(daily / 10.0 * 100, source=daily)


def water_index(deficit: Column, pr_sum: Column, eto_sum: Column,
                w: StressWeights = STRESS_WEIGHTS) -> Column:
    return weighted_present([(w.deficit, deficit_score(deficit), deficit), (w.rain, rain_score(pr_sum), pr_sum),
                             (w.demand, demand_score(eto_sum), eto_sum)])


def heat_index(lst: Column, vpd: Column, w: StressWeights = STRESS_WEIGHTS) -> Column:
    return weighted_present([(w.surface_heat, surface_heat_score(lst), lst), (w.dry_air, vpd_score(vpd), vpd)])


def vegetation_index(ndvi: Column) -> Column:
    return (F.when(ndvi.isNull(), 0.0)
            .when(ndvi < 0.3, 100.0)
            .when(ndvi < 0.5, 70 - (ndvi - 0.3) / 0.2 * 25)
            .when(ndvi < 0.7, 30 - (ndvi - 0.5) / 0.2 * 20)
            .otherwise(F.greatest(F.lit(0.0), 10 - (ndvi - 0.7) / 0.23 * 10)))


def atmospheric_index(vpd: Column, eto: Column, w: StressWeights = STRESS_WEIGHTS) -> Column:
    return weighted_present([(w.air_vpd, vpd_score(vpd), vpd), (w.air_eto, eto_score(eto), eto)])


def composite_index(water: Column, heat: Column, vegetation: Column, atmosphere: Column,
                    w: StressWeights = STRESS_WEIGHTS) -> Column:
    """Weighted sum of the four parts, which are never missing."""
    total = water * w.water + heat * w.heat + vegetation * w.vegetation + atmosphere * w.atmosphere
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def water_driver(deficit: Column, pr_sum: Column) -> Column:
    return (F.when(deficit_score(deficit) > 60, "High water deficit")
            .when(rain_score(pr_sum) > 60, "Low precipitation")
            .otherwise("Moderate water stress across indicators"))


def heat_driver(lst: Column, vpd: Column) -> Column:
    return (F.when(surface_heat_raw(lst) > 50, F.format_string("High temperature (%.1f°C)", half_up(lst, 1)))
            .when(vpd_score(vpd) > 50, "High atmospheric dryness")
            .otherwise("Moderate heat stress"))


def vegetation_driver(ndvi: Column) -> Column:
    return (F.when(ndvi.isNull(), "No NDVI data")
            .otherwise(F.format_string("NDVI %.3f (vegetation vigor)", half_up(ndvi, 3))))


def recommendations(overall: Column, water: Column, heat: Column, vegetation: Column,
                    week: Column) -> Column:
    """Ordered advice lines; heat above 70 outside weeks 8 to 10 adds none."""
    pollination = week.between(8, 10)
    lines = F.array(
        F.when(water > 70, "🚨 CRITICAL: Implement emergency irrigation if available")
        .when(water > 50, "⚠️  Monitor soil moisture closely - irrigation recommended"),
        F.when(water > 70, "Consider harvesting early if grain fill advanced")
        .when(water > 50, "Apply water management practices"),
        F.when((heat > 70) & week.isNotNull(), F.when(
            pollination,
            "🌡️  CRITICAL PERIOD: High heat during pollination - monitor pollen viability"))
        .when(heat > 50, "⚠️  High temperatures - ensure adequate water availability"),
        F.when(vegetation > 60, "Investigate vegetation stress - check for pests/disease")
        .when(vegetation > 40, "Monitor for signs of pest or disease pressure"),
        F.when(vegetation > 60, "Consider nutrient status evaluation"),
        F.when(overall > 70, "⚠️  HIGH OVERALL STRESS: Consider crop insurance claim documentation"),
    )
    given = F.array_compact(lines)
    favourable = F.array(F.lit("✅ Conditions are favorable - continue standard management"))
    return F.when(F.size(given) == 0, favourable).otherwise(given)
