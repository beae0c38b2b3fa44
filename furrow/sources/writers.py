"""Table writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: str | None = "year",
                increment: bool = False) -> None:
    """Replace a Parquet table, or with ``increment`` only the partitions present in ``df``.

    Rows are gathered per partition value in pieces of even size, which the adaptive
    planner cuts and joins, and ordered by key inside the files so that footer
    statistics prune well.
    """
    keys = [c for c in ("fips", "date", "week_start") if c in df.columns]
    if partition_by and keys:
        df = df.hint("rebalance", F.col(partition_by)).sortWithinPartitions(partition_by, *keys)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if increment:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_chunks(df: DataFrame, path: str, collection: str | None = "corn-stress-knowledge") -> None:
    """Append chunks to the chunk table, partitioned by collection.

    With ``collection=None`` each row brings its own, so any number of collections is one write.
    """
    named = df if collection is None else df.withColumn("collection", F.lit(collection))
    named.hint("rebalance", F.col("collection")).write.mode("append").partitionBy("collection").parquet(path)


def delete_collection(spark: SparkSession, path: str, collection: str) -> int:
    """Remove a collection from the chunk table; only its own folders are touched. Returns how many there were."""
    rows = spark.read.parquet(path).filter(F.col("collection") == collection)
    folders = rows.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct()
    found = [r["folder"] for r in folders.collect()]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in found:
        place = hadoop.Path(spark.sparkContext._jvm.java.net.URI(folder))
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(found)
