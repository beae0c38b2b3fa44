"""Session helpers: a local session for tests and the shared folder of a cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Written tables that grow with the texts: smaller on disk counts for more than the time to compress them.
LARGE = frozenset({"blocks", "chunks", "counted", "postings", "terms"})

_test_folders: dict[str, str | None] = {}


def local_session(cpus: int = 8, name: str = "furrow") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.streaming.metricsEnabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where that is unset and all work is in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        folder = _test_folders.setdefault(spark.sparkContext.applicationId, None)
        if folder is None:
            folder = _test_folders[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="furrow-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """Cut lineage by writing the frame to the shared folder, with options of the writer; survives lost executors."""
    path = new_path(df.sparkSession, name)
    if name in LARGE:
        options = {"compression": "zstd"} | options
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(sources: Sequence[DataFrame]) -> tuple[int, int]:
    """Number and digest of the files the frames read: names, lengths and times of change, never their content."""
    spark = sources[0].sparkSession
    files = sorted({unquote(f) for s in sources for f in s.inputFiles()})
    if not files:
        return 0, 0
    listed = spark.read.format("binaryFile").load(files).select(F.xxhash64("path", "modificationTime", "length").alias("v"))
    return tuple(listed.agg(F.count("*"), F.bit_xor("v")).first())


_stored: dict[tuple, str] = {}


def stored(name: str, sources: Sequence[DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
    """A table of the pipeline: written once per session and version of the input files, then read by every query.

    A file that is replaced under its own name has another length or time of change, so the table is built again.
    """
    spark = sources[0].sparkSession
    files = tuple(sorted(f for s in sources for f in s.inputFiles()))
    key = (spark.sparkContext.applicationId, shared_folder(spark), name, files, versions(sources))
    if key not in _stored:
        path = new_path(spark, name)
        build().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def refresh() -> None:
    """Forget the stored tables, so that the next query builds them again."""
    _stored.clear()


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan to all cores where the input has fewer splits than cores.

    For work that is heavy per row (text, vectors) over few or unsplittable files;
    an input with many splits is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
