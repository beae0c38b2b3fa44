"""Band and label expressions. The bounds and labels are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions.scalars import steps

STATUS = [(20, "healthy"), (40, "mild"), (60, "moderate"), (80, "severe")]
DASHBOARD = [(20, "Healthy"), (40, "Mild Stress"), (60, "Moderate Stress")]


def stress_status(index: Column) -> Column:
    return steps(index, STATUS, "critical")


def stress_label4(index: Column) -> Column:
    return F.coalesce(steps(index, DASHBOARD, "Severe Stress"), F.lit("N/A"))


def yield_band(bushels: Column) -> Column:
    return (F.when(bushels.isNull(), None).when(bushels < 80, "severe drought")
            .when(bushels < 120, "below typical").when(bushels <= 200, "typical")
            .otherwise("excellent"))


def rain_class(mm: Column) -> Column:
    return steps(mm, [(0, "dry"), (5, "light"), (15, "moderate"), (25, "heavy"), (50, "very heavy")],
                 "extreme", inclusive=True)


def deficit_band(mm: Column) -> Column:
    """<0 surplus, [0,2] normal, (2,4] moderate, (4,6] high, above severe."""
    return (F.when(mm.isNull(), None).when(mm < 0, "surplus").when(mm <= 2, "normal")
            .when(mm <= 4, "moderate").when(mm <= 6, "high").otherwise("severe"))


def deficit_step(mm: Column) -> Column:
    return steps(mm, [(0, 0), (2, 20), (4, 50), (6, 75)], 100)


def ndvi_ratio_step(current: Column, normal: Column) -> Column:
    ratio = F.try_divide(current, normal)
    return (F.when(ratio.isNull(), None).when(ratio > 1.0, 0).when(ratio > 0.9, 20)
            .when(ratio > 0.8, 50).when(ratio > 0.7, 75).otherwise(100))


def anomaly_class(z: Column) -> Column:
    return steps(F.abs(z), [(0.5, "normal"), (1.0, "mild"), (2.0, "moderate")], "severe",
                 inclusive=True)


def yield_factor(index: Column) -> Column:
    """Share of potential yield for a pollination health score, as the band's text."""
    return (F.when(index.isNull(), None).when(index > 80, "100%").when(index >= 60, "90-100%")
            .when(index >= 40, "70-90%").when(index >= 20, "50-70%").otherwise("<50%"))
