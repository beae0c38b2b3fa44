"""A keep-last table as sorted runs in buckets, merged by size tiers (a log-structured merge tree of Parquet files).

A run is a folder ``run=<first batch>_<last batch>``, partitioned by bucket of the key and sorted by key. It counts
once its ``_SUCCESS`` is there, and it replaces every run of fewer batches inside its range. So a merge that dies half
way leaves the old runs in force, and there is no list of runs that could disagree with the files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.sources.increments import keep_last

FANOUT = 4
BUCKETS = 16


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def written_runs(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """First and last batch of every complete run."""
    files, path = _files(spark, target)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    found = []
    for name in names:
        if name.startswith("run=") and files.exists(_files(spark, f"{target}/{name}/_SUCCESS")[1]):
            first, _, last = name[4:].partition("_")
            found.append((int(first), int(last)))
    return found


def live_runs(runs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that no wider one replaces, by batch."""
    return sorted(r for r in runs if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs))


def tier(run: tuple[int, int], fanout: int = FANOUT) -> int:
    """0 for one batch, 1 for up to ``fanout`` of them, and so on."""
    size, level = run[1] - run[0] + 1, 0
    while size > 1:
        size, level = -(-size // fanout), level + 1
    return level


def _write(rows: DataFrame, target: str, run: tuple[int, int], keys: Sequence[str], buckets: int) -> None:
    """One file per bucket with rows; a run written again replaces itself."""
    dealt = rows.withColumn("bucket", bucket_of(keys, buckets)).repartition(F.col("bucket"))
    dealt.sortWithinPartitions("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(
        f"{target}/run={run[0]}_{run[1]}")


def add_batch(rows: DataFrame, batch_id: int, target: str, keys: Sequence[str], row_order: Sequence[str],
              buckets: int = BUCKETS, fanout: int = FANOUT) -> None:
    """Add the last row per key of a batch as a run, then merge tiers that have become full. Repeating it is harmless."""
    reduced = keep_last(rows, list(keys), list(row_order)).withColumn("batch", F.lit(batch_id).cast("long"))
    _write(reduced, target, (batch_id, batch_id), keys, buckets)
    merge_full_tiers(rows.sparkSession, target, keys, row_order, buckets, fanout)


def merge_full_tiers(spark: SparkSession, target: str, keys: Sequence[str], row_order: Sequence[str],
                     buckets: int = BUCKETS, fanout: int = FANOUT) -> int:
    """Merge ``fanout`` neighbouring runs of one tier into one of the next, until no tier is full; returns the merges."""
    merges = 0
    while True:
        live = live_runs(written_runs(spark, target))
        full = next((live[k:k + fanout] for k in range(len(live) - fanout + 1)
                     if len({tier(r, fanout) for r in live[k:k + fanout]}) == 1), None)
        if full is None:
            return merges
        rows = _last_either_way(_read(spark, target, full), list(keys), list(row_order))
        _write(rows, target, (full[0][0], full[-1][1]), keys, buckets)
        merges += 1


def _last_either_way(rows: DataFrame, keys: list[str], row_order: list[str]) -> DataFrame:
    """The last row per key by arrival and the last one by ``row_order``: two rows at most, from which both readings follow."""
    row = F.struct(*[c for c in rows.columns if c not in keys])
    last = [F.max_by(row, F.struct(*order)) for order in (["batch", *row_order], [*row_order, "batch"])]
    return rows.groupBy(*keys).agg(F.array_distinct(F.array(*last)).alias("rows")).select(
        *keys, F.explode("rows").alias("row")).select(*keys, "row.*").select(*rows.columns)


def _read(spark: SparkSession, target: str, runs: Sequence[tuple[int, int]]) -> DataFrame:
    paths = [f"{target}/run={first}_{last}" for first, last in runs]
    return spark.read.option("basePath", target).parquet(*paths).drop("run", "bucket")


def drop_replaced(spark: SparkSession, target: str) -> int:
    """Delete the runs that a wider one replaces, for the time when nobody reads them any more; returns their number."""
    runs = written_runs(spark, target)
    old = set(runs) - set(live_runs(runs))
    for first, last in old:
        files, path = _files(spark, f"{target}/run={first}_{last}")
        files.delete(path, True)
    return len(old)


def read_current(spark: SparkSession, target: str, keys: Sequence[str], row_order: Sequence[str], by_arrival: bool = True,
                 where: Mapping[str, object] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Last row per key, with ``batch``: by arrival, or by ``row_order`` alone.

    ``where`` gives a value for every key column: then one bucket of each live run is read, and in it the row groups
    whose key range holds the value. There are fewer than ``fanout`` runs a tier, and the tiers grow with the logarithm
    of the number of batches.
    """
    runs = live_runs(written_runs(spark, target))
    paths = [f"{target}/run={first}_{last}" for first, last in runs]
    rows = spark.read.option("basePath", target).parquet(*paths)
    if where is not None:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        values = {k: F.lit(where[k]).cast(kinds[k]) for k in keys}
        one = spark.range(1).select(F.pmod(F.xxhash64(*(values[k] for k in keys)), F.lit(buckets)).cast("int")).first()[0]
        rows = rows.filter(F.col("bucket") == one)
        for key in keys:
            rows = rows.filter(F.col(key) == values[key])
    order = ["batch", *row_order] if by_arrival else [*row_order, "batch"]
    return keep_last(rows.drop("run", "bucket"), list(keys), order)
