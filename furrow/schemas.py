"""Schemas of the stored tables, declared once."""

from __future__ import annotations

from pyspark.sql import types as T

from furrow.config import INDICATORS


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_S, _I, _D, _DT = T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType()

OBSERVATION = _fields(
    ("date", _DT), ("fips", _S), ("county_name", _S),
    ("mean", _D), ("std", _D), ("min", _D), ("max", _D), ("mask_year", _I),
)

WATER_DEFICIT = _fields(
    ("date", _DT), ("fips", _S), ("county_name", _S), ("eto_mean", _D), ("pr_mean", _D),
    ("water_deficit", _D), ("eto_std", _D), ("pr_std", _D), ("mask_year", _I),
)

YIELDS = _fields(
    ("year", _I), ("state", _S), ("state_fips", _S), ("county", _S), ("county_fips", _S),
    ("yield_bu_per_acre", _D), ("unit", _S), ("fips", _S),
)

YIELD_RECORD = _fields(
    ("year", _S), ("state_name", _S), ("state_fips_code", _S), ("county_name", _S),
    ("county_code", _S), ("Value", _S), ("unit_desc", _S),
)

DAILY = _fields(
    ("date", _DT), ("fips", _S), ("county_name", _S),
    ("year", _I), ("month", _I), ("doy", _I), ("week_of_season", _I),
    *[(f"{name}_{stat}", _D) for name in INDICATORS for stat in ("mean", "std")],
)

WEEKLY = _fields(
    ("week_start", _DT), ("year", _I), ("week_of_season", _I), ("fips", _S), ("county_name", _S),
    *[(f"{name}_{stat}", _D) for name in INDICATORS for stat in ("mean", "std")],
    ("pr_sum", _D), ("eto_sum", _D), ("water_deficit_sum", _D), ("ndvi_min", _D), ("ndvi_max", _D),
    ("lst_max", _D), ("vpd_max", _D), ("lst_days_above_32", T.LongType()),
)

GEO_COLLECTION = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.MapType(_S, _S)),
    ]))),
])
