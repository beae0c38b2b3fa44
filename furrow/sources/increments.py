"""Incremental loads: high-water mark, keep-last upsert, missing years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import materialise
from furrow.sources.writers import write_table


def next_start(df: DataFrame, default: str, today: Column | None = None, date: str = "date") -> DataFrame:
    """One row: last stored date, the next start and whether there is anything to load."""
    today = F.current_date() if today is None else today
    return df.agg(F.max(date).alias("last_date")).select(
        "last_date",
        F.coalesce(F.date_add("last_date", 1), F.lit(default).cast("date")).alias("start_date"),
    ).withColumn("up_to_date", F.col("start_date") > today)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key by the order columns.

    An aggregate, not a window: each task first reduces its own rows, so a key
    that holds a large share of the table is never gathered whole.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, "__last.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], row_order: list[str]) -> DataFrame:
    """Old and new rows by column name, the last row per key kept; new rows beat old ones.

    ``row_order`` names the columns that order rows inside one batch.
    """
    both = old.withColumn("__batch", F.lit(0)).unionByName(
        new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ["__batch", *row_order]).drop("__batch")


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], row_order: list[str],
                 partition: str = "year") -> None:
    """Upsert into a table partitioned by ``partition``; other partitions than those of ``new`` are not touched.

    The values of the partition column in ``new`` come to the driver: an increment brings few. The changed
    partitions are written aside before they replace the old ones.
    """
    touched = [r[0] for r in new.select(partition).distinct().collect()]
    if touched:
        old = spark.read.schema(new.schema).parquet(path).filter(F.col(partition).isin(touched))
        write_table(materialise(upsert(old, new, keys, row_order), "increment"), path, partition, increment=True)


def missing_years(spark: SparkSession, df: DataFrame, low: int, high: int, year: str = "year") -> DataFrame:
    target = spark.range(low, high + 1).select(F.col("id").cast("int").alias(year))
    return target.join(df.select(F.col(year).cast("int").alias(year)).distinct(), year, "left_anti")


def ingest_summary(df: DataFrame, date: str = "date", measure: str = "mean",
                   is_new: Column | None = None) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.lit(False) if is_new is None else is_new).alias("new_rows"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.countDistinct("fips").alias("counties"), F.avg(measure).alias("mean_value"),
    )
