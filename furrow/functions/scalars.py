"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 100.0, source: Column | None = None) -> Column:
    """Bounded value; a missing value stays missing (greatest and least alone would drop it).

    ``source`` is the column the value is missing with, where that is simpler to test.
    """
    present = (value if source is None else source).isNotNull()
    return F.when(present, F.greatest(F.lit(low), F.least(F.lit(high), value)))


def half_up(value: Column, digits: int = 2, noise: float = 5e-9) -> Column:
    """Decimal rounding, halves away from zero, that ignores binary noise below ``noise``.

    Plain arithmetic: the built-in ``round`` goes through a decimal object per value.
    """
    scale = 10.0 ** digits
    return F.signum(value) * F.floor(F.abs(value) * scale + (0.5 + noise * scale)) / scale + 0.0


def weighted_present(parts: list[tuple[float, Column, Column]]) -> Column:
    """Weighted mean of the parts whose input is present; 0 when none is.

    Parts are (weight, value, input): presence is read off the plain input column,
    so that the value's expression appears once.
    """
    total = reduce(lambda a, b: a + b, [F.coalesce(v * w, F.lit(0.0)) for w, v, _ in parts])
    weight = reduce(lambda a, b: a + b,
                    [F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for w, _, x in parts])
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def steps(value: Column, uppers: list[tuple[float, object]], otherwise, inclusive: bool = False) -> Column:
    """Label of the first upper bound the value stays under; missing values give null."""
    chain = F.when(value.isNull(), None)
    for upper, label in uppers:
        chain = chain.when(value <= upper if inclusive else value < upper, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def first_present(*columns: str) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


def suffix_cols(df: DataFrame, *suffixes: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffixes)]


def is_valid_fips(code: Column, state: str = "19") -> Column:
    return F.coalesce(code.rlike(f"^{state}[0-9]{{3}}$"), F.lit(False))


def is_iso_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.lit(False)) & (
        F.try_to_date(text, "yyyy-M-d").isNotNull())


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of a missing value: NaN becomes null at the scan."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])
