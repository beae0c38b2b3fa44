"""Exact linear-interpolated quantiles that gather no column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 512
READ_OFF = 5_000

Key = tuple[object, str]  # group, column


def grouped_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], group: str | None = None,
                      read_off: int = READ_OFF) -> dict[Key, list[float | None]]:
    """Quantiles per group and column, as numpy interpolates them; groups are few (a result row each).

    Every pass counts the values in the bins of the current bracket around each wanted rank, all in one scan, and
    keeps the bin that holds the rank, with the least and greatest value found in it. A bracket of at most
    ``read_off`` rows, or of a single value, is read off. Nulls and NaN are left out; infinities count as values
    below and above all others, and interpolating towards one gives it. A bracket shrinks to a bin of a 512th of its
    width, so the passes end whatever the values are.
    """
    group_column = F.lit(None).cast("string") if group is None else F.col(group)
    values = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(group_column.alias("g"), F.explode(values).alias("x")).select("g", "x.c", "x.v")
    long = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    inf = float("inf")
    finite = F.when(F.abs("v") < inf, F.col("v"))
    heads = long.groupBy("g", "c").agg(
        F.count("*").alias("n"), F.count_if(F.col("v") == -inf).alias("low"), F.count_if(F.col("v") == inf).alias("high"),
        F.min(finite).alias("lo"), F.max(finite).alias("hi")).collect()
    found: dict[tuple[Key, int], float] = {}
    brackets: dict[tuple[Key, int], tuple[float, float, int, int]] = {}
    for r in heads:
        for rank in {f(p * (r["n"] - 1)) for p in probs for f in (math.floor, math.ceil)}:
            at = ((r["g"], r["c"]), rank)
            if rank < r["low"]:
                found[at] = -inf
            elif rank >= r["n"] - r["high"]:
                found[at] = inf
            else:
                brackets[at] = (r["lo"], r["hi"], r["low"], r["n"] - r["low"] - r["high"])
    while brackets:
        found |= {at: b[0] for at, b in brackets.items() if b[0] == b[1]}
        small = {at: b for at, b in brackets.items() if at not in found and b[3] <= read_off}
        found |= _read_off(long, small)
        brackets = _narrowed(long, {at: b for at, b in brackets.items() if at not in found})
    counts = {(r["g"], r["c"]): r["n"] for r in heads}
    groups = {r["g"] for r in heads} or ({None} if group is None else set())
    return {(g, c): [_blend(found, (g, c), p * (counts[g, c] - 1)) if (g, c) in counts else None for p in probs]
            for g in groups for c in columns}


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], read_off: int = READ_OFF
                    ) -> dict[str, list[float | None]]:
    """Quantiles per column over all rows."""
    return {c: q for (_, c), q in grouped_quantiles(df, columns, probs, read_off=read_off).items()}


def _blend(found: dict[tuple[Key, int], float], key: Key, position: float) -> float:
    low, high = found[key, math.floor(position)], found[key, math.ceil(position)]
    share = position - math.floor(position)
    if low == high or not share:
        return low
    return low + (high - low) * share if math.isfinite(low) else (low if math.isinf(low) and math.isfinite(high) else math.nan)


def _spans(long: DataFrame, brackets: dict) -> tuple[DataFrame, dict]:
    """Rows that fall in a bracket, with the bracket's number; the brackets are a few rows per group."""
    numbers = {span: i for i, span in enumerate(dict.fromkeys((*at[0], b[0], b[1]) for at, b in brackets.items()))}
    kind = long.schema["g"].dataType.simpleString()
    table = long.sparkSession.createDataFrame(
        [(g, c, lo, hi, i) for (g, c, lo, hi), i in numbers.items()], f"g {kind}, c string, lo double, hi double, span int")
    table = F.broadcast(table.withColumnsRenamed({"g": "_g", "c": "_c"}))
    same = long["g"].eqNullSafe(F.col("_g")) & (long["c"] == F.col("_c")) & F.col("v").between(F.col("lo"), F.col("hi"))
    return long.join(table, same).select("span", "v", "lo", "hi"), numbers


def _narrowed(long: DataFrame, brackets: dict) -> dict:
    if not brackets:
        return {}
    rows, numbers = _spans(long, brackets)
    half: Column = F.col("hi") / 2 - F.col("lo") / 2  # halves, so that the width does not overflow
    place = F.floor((F.col("v") / 2 - F.col("lo") / 2) / half * BINS)
    counts = rows.groupBy("span", F.least(place, F.lit(BINS - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    bins: dict[int, list] = {}
    for row in sorted(counts, key=lambda r: (r["span"], r["bin"])):
        bins.setdefault(row["span"], []).append(row)
    out = {}
    for at, (lo, hi, below, _) in brackets.items():
        for row in bins[numbers[(*at[0], lo, hi)]]:
            if at[1] < below + row["n"]:
                out[at] = (row["lo"], row["hi"], below, row["n"])
                break
            below += row["n"]
    return out


def _read_off(long: DataFrame, brackets: dict) -> dict:
    if not brackets:
        return {}
    rows, numbers = _spans(long, brackets)
    lists = {r["span"]: r["values"] for r in rows.groupBy("span").agg(F.sort_array(F.collect_list("v")).alias("values")).collect()}
    return {at: lists[numbers[(*at[0], b[0], b[1])]][at[1] - b[2]] for at, b in brackets.items()}
