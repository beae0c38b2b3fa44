"""Gapless row numbers over a whole table, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import materialise

_POSITION = (1 << 33) - 1  # monotonically_increasing_id keeps the position within a task in its lower 33 bits


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """``df`` with a gapless number from 0 in the order of ``order`` (nulls first).

    Rows are range-partitioned and sorted once and written; each task's rows then shift by the count of the tasks
    before it, which is one row per task. Rows that agree in ``order`` may change places, so order by every column
    that matters. An empty table stays empty. ``df`` should be cheap to read twice (range bounds are sampled).
    """
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialise(ranged.withColumn("_task", F.spark_partition_id()).withColumn("_at", place.bitwiseAND(F.lit(_POSITION))))
    counts = ranged.groupBy("_task").agg(F.count("*").alias("n"))
    so_far = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_task", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_task").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_at")).alias(name))
