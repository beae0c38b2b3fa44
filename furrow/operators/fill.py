"""Gap filling of the daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.scalars import suffix_cols


def fill(df: DataFrame, mode: str = "none", columns: list[str] | None = None, max_age: int = 16) -> DataFrame:
    """Fill gaps: ``none``, ``zero``, ``locf`` (up to ``max_age`` days) or ``linear``.

    The windows run per county and season, at most 184 rows of the complete grid each.
    """
    columns = columns if columns is not None else suffix_cols(df, "_mean", "_std")
    if mode == "none":
        return df
    if mode == "zero":
        return df.fillna(0.0, subset=columns)
    season = Window.partitionBy("fips", "year").orderBy("date")
    if mode == "locf":
        recent = season.rowsBetween(-(max_age - 1), 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(recent) for c in columns})
    if mode == "linear":
        return _linear(df, columns, season)
    raise ValueError(f"unknown fill mode {mode!r}")


def _linear(df: DataFrame, columns: list[str], season) -> DataFrame:
    before = season.rowsBetween(Window.unboundedPreceding, 0)
    after = season.rowsBetween(0, Window.unboundedFollowing)
    known = {}
    for c in columns:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col("date").alias("d"), F.col(c).alias("v")))
        known[f"__p_{c}"] = F.last(point, ignorenulls=True).over(before)
        known[f"__n_{c}"] = F.first(point, ignorenulls=True).over(after)
    marked = df.withColumns(known)
    filled = {}
    for c in columns:
        p, n = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        share = F.datediff(F.col("date"), p["d"]) / F.datediff(n["d"], p["d"])
        filled[c] = F.coalesce(
            F.col(c), F.when(p.isNotNull() & n.isNotNull() & (n["d"] > p["d"]),
                             p["v"] + (n["v"] - p["v"]) * share))
    return marked.withColumns(filled).drop(*known)
