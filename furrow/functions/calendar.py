"""Season calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.config import SEASON, Season


def season_start(year: Column, season: Season = SEASON) -> Column:
    return F.make_date(year, F.lit(season.first_month), F.lit(season.first_day))


def season_end(year: Column, season: Season = SEASON) -> Column:
    return F.make_date(year, F.lit(season.last_month), F.lit(season.last_day))


def week_of_season(date: Column) -> Column:
    """1-based week counted from the first day of the season."""
    return (F.floor(F.datediff(date, season_start(F.year(date))) / 7) + 1).cast("int")


def week_start(year: Column, week: Column) -> Column:
    return F.date_add(season_start(year), ((week - 1) * 7).cast("int"))


def in_season(df: DataFrame, date: str = "date", season: Season = SEASON) -> DataFrame:
    return df.filter(F.month(date).between(season.first_month, season.last_month))


def between_dates(df: DataFrame, low=None, high=None, date: str = "date",
                  inclusive_end: bool = False) -> DataFrame:
    """Optional date bounds; the end is exclusive unless asked otherwise."""
    if low is not None:
        df = df.filter(F.col(date) >= F.lit(low).cast("date"))
    if high is not None:
        end = F.lit(high).cast("date")
        df = df.filter(F.col(date) <= end if inclusive_end else F.col(date) < end)
    return df


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    day = F.col(date)
    return df.withColumns({
        "year": F.year(day), "month": F.month(day), "doy": F.dayofyear(day),
        "week_of_season": week_of_season(day),
    })
