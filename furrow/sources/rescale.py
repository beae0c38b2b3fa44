"""Raw sensor encodings to physical units. The factors are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATS = ("mean", "std", "min", "max")
NDVI_FACTOR = 0.0001
LST_FACTOR = 0.02
KELVIN = 273.15


def rescale(df: DataFrame, indicator: str, vpd_divisor: float = 1.0, shift_std: bool = False) -> DataFrame:
    """Physical values of the four statistics.

    The temperature offset moves locations, not spreads; ``shift_std`` applies it
    to the std as well, as the published tables have it. Vapour pressure deficit
    arrives in kPa; a source in Pa passes ``vpd_divisor=1000``.
    """
    if indicator == "ndvi":
        return df.withColumns({c: F.col(c) * NDVI_FACTOR for c in STATS})
    if indicator == "lst":
        return df.withColumns({
            c: F.col(c) * LST_FACTOR - (KELVIN if c != "std" or shift_std else 0.0) for c in STATS})
    if indicator == "vpd":
        return df.withColumns({c: F.col(c) / vpd_divisor for c in STATS})
    return df
