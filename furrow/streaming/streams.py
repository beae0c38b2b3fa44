"""The incremental jobs as Structured Streaming queries.

Repeats and open weeks are held in Spark's own state, which a watermark bounds; upserts go to sorted runs that are
merged by tiers. Rows that come after their week was closed are not lost: they are counted beside the closed weeks, so
closed, late and open parts add up to the batch result, however the rows were split or ordered. Alerts for counties
that fall silent are in :mod:`alerts`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from furrow.functions.calendar import week_of_season, week_start
from furrow.operators.stress import score
from furrow.streaming import tiers

MEASURES = ("ndvi", "lst", "vpd", "eto", "pr", "water_deficit")
WEEK = ("year", "week_of_season", "fips")


def _log(stream: DataFrame, target: str, checkpoint: str, reduce: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run over what is available; every batch adds what it reduces to."""
    def write(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_upsert(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str],
                  row_order: Sequence[str]) -> StreamingQuery:
    """Continuous keep-last upsert into the sorted runs of :mod:`tiers`; a batch that is run again replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        tiers.add_batch(batch, batch_id, target, keys, row_order)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_upserted(spark: SparkSession, target: str, keys: Sequence[str], row_order: Sequence[str],
                  by_arrival: bool = True, where: Mapping[str, object] | None = None) -> DataFrame:
    """Current rows of a table kept by :func:`stream_upsert`: the last one by arrival, or by ``row_order`` alone.

    ``where`` looks up one key (a value for each of ``keys``) in a bucket of each live run.
    """
    return tiers.read_current(spark, target, keys, row_order, by_arrival, where).drop("batch")


def compact_upserted(spark: SparkSession, target: str, into: str, keys: Sequence[str], row_order: Sequence[str]) -> None:
    """Resolve a table of :func:`stream_upsert` into a new one of a single run, numbered before all later batches."""
    rows = tiers.read_current(spark, target, keys, row_order).withColumn("batch", F.lit(-1).cast("long"))
    tiers.add_batch(rows.drop("batch"), -1, into, keys, row_order)


def distinct_within(stream: DataFrame, keys: Sequence[str], horizon: str, event_time: str = "ts") -> DataFrame:
    """Streaming rows of ``keys``, each once within ``horizon`` of event time.

    State holds the keys of that time only: once the watermark (the newest event less ``horizon``) has passed a key,
    it is forgotten. A row older than the watermark is not looked at.
    """
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def stream_dedup(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], horizon: str = "184 days") -> StreamingQuery:
    """Write each key once; the default horizon is a season, the time in which observations are revised."""
    rows = distinct_within(stream, keys, horizon)
    return (rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def read_distinct(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def with_season_week(rows: DataFrame, event_time: str = "ts") -> DataFrame:
    """Year and season week of an event."""
    day = F.to_date(event_time)
    return rows.withColumns({"year": F.year(day), "week_of_season": week_of_season(day)})


def _totals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    stats = [f(f"{n}_mean").alias(f"{n}_{k}") for n in MEASURES for k, f in (("sum", F.sum), ("count", F.count))]
    return rows.groupBy(*keys).agg(*stats, F.count("*").alias("rows"))


def _added(parts: DataFrame, sign: Column | None = None) -> list[Column]:
    names = [f"{n}_{k}" for n in MEASURES for k in ("sum", "count")] + ["rows"]
    return [F.sum(F.col(c) if sign is None else F.col(c) * sign).alias(c) for c in names]


def closed_weeks(stream: DataFrame, late_weeks: int = 1) -> DataFrame:
    """Streaming totals of each county week, given out once when it closes (append mode).

    A week closes when a row has come whose week begins ``late_weeks`` or more after it; state holds the open weeks
    alone. The watermark is set on the first day of the week, so it moves by weeks of the season, whatever weekday the
    season begins on. Sums of a hot county are formed in the map tasks before they meet.
    """
    week = week_start(F.col("year"), F.col("week_of_season")).cast("timestamp")
    rows = with_season_week(stream).withColumn("week_ts", week)
    return _totals(rows.withWatermark("week_ts", f"{7 * late_weeks} days"), ["week_ts", *WEEK])


def stream_weekly(stream: DataFrame, target: str, checkpoint: str, late_weeks: int = 1) -> StreamingQuery:
    """Weekly roll-up of daily rows: closed weeks as they leave the state, and what has arrived for every week.

    The second query keeps a few numbers per batch, county and week; it is what late rows are told from.
    """
    closed = (closed_weeks(stream, late_weeks).writeStream.format("parquet").option("path", f"{target}/closed")
              .option("checkpointLocation", f"{checkpoint}/closed").outputMode("append").trigger(availableNow=True).start())
    closed.awaitTermination()
    return _log(stream, f"{target}/arrived", f"{checkpoint}/arrived", lambda batch: _totals(with_season_week(batch), WEEK))


def _closed(spark: SparkSession, target: str) -> DataFrame:
    names = [f"{n}_{k} {t}" for n in MEASURES for k, t in (("sum", "double"), ("count", "long"))]
    form = f"week_ts timestamp, year int, week_of_season int, fips string, {', '.join(names)}, rows long"
    return spark.read.schema(form).parquet(f"{target}/closed")


def read_closed(spark: SparkSession, target: str) -> DataFrame:
    """Closed weeks with means and totals, as they left the stream."""
    return _present(_closed(spark, target)).withColumn("open", F.lit(False))


def read_rest(spark: SparkSession, target: str, late_weeks: int = 1) -> DataFrame:
    """Totals of what is not in the closed weeks; ``late``: it came after its week was closed, else its week is open."""
    arrived = spark.read.parquet(f"{target}/arrived")
    both = arrived.select(*WEEK, *_columns(arrived), F.lit(1).alias("sign")).unionByName(
        _closed(spark, target).select(*WEEK, *_columns(arrived), F.lit(-1).alias("sign")))
    rest = both.groupBy(*WEEK).agg(*_added(both, F.col("sign"))).filter("rows > 0")
    first_day = week_start(F.col("year"), F.col("week_of_season"))
    newest = arrived.agg(F.max(first_day)).scalar()
    return rest.withColumn("late", first_day <= F.date_sub(newest, 7 * late_weeks))


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith(("_sum", "_count"))] + ["rows"]


def read_late(spark: SparkSession, target: str, late_weeks: int = 1) -> DataFrame:
    """Rows and totals per county week that came after the week was closed."""
    return read_rest(spark, target, late_weeks).filter("late").drop("late")


def _present(totals: DataFrame) -> DataFrame:
    means: list[Column] = [F.try_divide(f"{n}_sum", f"{n}_count").alias(f"{n}_mean") for n in MEASURES]
    first_day = week_start(F.col("year"), F.col("week_of_season"))
    none = [F.when(F.col(f"{n}_count") > 0, F.col(f"{n}_sum")).alias(f"{n}_sum") for n in ("pr", "eto")]
    return totals.select(first_day.alias("week_start"), *WEEK, *means, *none)


def read_weekly(spark: SparkSession, target: str, late_weeks: int = 1) -> DataFrame:
    """County weeks with means and totals, late rows added; ``open`` marks weeks after which no row has arrived yet."""
    rest = read_rest(spark, target, late_weeks)
    parts = _closed(spark, target).select(*WEEK, *_columns(rest)).unionByName(rest.drop("late"))
    weeks = _present(parts.groupBy(*WEEK).agg(*_added(parts)))
    newest = spark.read.parquet(f"{target}/arrived").agg(F.max(week_start(F.col("year"), F.col("week_of_season")))).scalar()
    return weeks.withColumn("open", F.col("week_start") >= newest)


def read_scores(spark: SparkSession, target: str, names: DataFrame) -> DataFrame:
    """Stress record of each week of :func:`read_weekly`; ``names`` holds fips and county_name."""
    return score(read_weekly(spark, target).join(names.select("fips", "county_name"), "fips", "left"))


def stream_score(stream: DataFrame, target: str, checkpoint: str, names: DataFrame, late_weeks: int = 1) -> StreamingQuery:
    """Write the stress record of each county week when it closes; the stream itself scores it, once."""
    closed = _present(closed_weeks(stream, late_weeks)).join(names.select("fips", "county_name"), "fips", "left")
    return (score(closed).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def stream_freshness(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Newest date per county and batch; see :func:`read_freshness`."""
    return _log(stream, target, checkpoint, lambda batch: batch.groupBy("fips").agg(F.max(F.to_date("ts")).alias("last_seen")))


def read_freshness(spark: SparkSession, target: str, limit_days: int = 7) -> DataFrame:
    """Age of every county's newest row against the newest of all, and whether it passes ``limit_days``."""
    log = spark.read.parquet(target)
    latest = log.groupBy("fips").agg(F.max("last_seen").alias("last_seen"))
    age = F.datediff(log.agg(F.max("last_seen")).scalar(), F.col("last_seen"))
    return latest.select("fips", "last_seen", age.alias("age_days"), (age > limit_days).alias("stale"))
