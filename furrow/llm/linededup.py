"""Incremental, reversible line dedup: sharded cuckoo filters in front of exact reference-count tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import new_path, spread

SPACE = b" \t\n\x0b\f\r"
SLOTS = 4
POSTING = "doc_id long, tid long, pos int, k1 long, k2 long"


def line_keys(text: bytes, min_chars: int) -> Iterator[tuple[int, int, int]]:
    """(position, first, second half of a 128-bit key hash) of every line whose key is long enough."""
    for pos, line in enumerate(text.split(b"\n")):
        key = line.strip(SPACE).lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            first = xxhash.xxh64_intdigest(key, 42)
            yield pos, first, xxhash.xxh64_intdigest(key, first)


def postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line with a key of at least ``min_chars`` code points; ``tid`` hashes the row's whole text."""
    rows = spread(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"),
        F.col("text").cast("binary").alias("text")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc_id, tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for row in line_keys(text.as_py(), min_chars):
                    for column, value in zip(out, (doc_id, tid, *row)):
                        column.append(value)
            signed = [np.array(c, np.uint64).view(np.int64) for c in out[3:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                 *map(pa.array, signed)], ["doc_id", "tid", "pos", "k1", "k2"])

    return rows.mapInArrow(scan, POSTING)


class CuckooFilter:
    """Cuckoo filter of 64-bit key hashes: 16-bit fingerprints in buckets of four, two buckets a key.

    A filter that fills up gets a further table; all tables are asked. Every key that was inserted is found; another
    key is taken for one with a chance of about 8 / 2**15 a table. Keys are deleted exactly if they were inserted.
    """

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @classmethod
    def read(cls, tables) -> CuckooFilter:
        return cls([np.frombuffer(t, "<u2").reshape(-1, SLOTS).copy() for t in tables])

    def write(self) -> list[bytes]:
        return [t.astype("<u2").tobytes() for t in self.tables]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for table in self.tables:
            mark, first = _place(table, keys)
            second = _other(table, mark, first)
            found |= ((table[first] == mark[:, None]) | (table[second] == mark[:, None])).any(axis=1)
        return found

    def insert(self, keys: np.ndarray) -> None:
        """Add keys that are not in the filter."""
        if len(keys) and self.tables and len(keys) + (self.tables[-1] > 0).sum() <= 0.8 * self.tables[-1].size:
            if _fill(self.tables[-1], keys):
                return
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) / (SLOTS * 0.8)))))
        while len(keys):
            table = np.zeros((buckets, SLOTS), np.uint16)
            if _fill(table, keys):
                self.tables.append(table)
                return
            buckets *= 2

    def delete(self, keys: np.ndarray) -> None:
        """Take out one copy of each key."""
        for key in keys:
            for table in reversed(self.tables):
                mark, first = _place(table, np.array([key]))
                buckets = np.array([first[0], _other(table, mark, first)[0]])
                at = np.argwhere(table[buckets] == mark[0])
                if len(at):
                    table[buckets[at[0, 0]], at[0, 1]] = 0
                    break


def _place(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and first bucket of each key."""
    keys = keys.astype(np.int64).view(np.uint64)
    mark = (keys >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    return mark, (keys & np.uint64(len(table) - 1)).astype(np.int64)


def _other(table: np.ndarray, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The other bucket of a fingerprint, from either of its two."""
    return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & (len(table) - 1))


def _fill(table: np.ndarray, keys: np.ndarray, rounds: int = 500) -> bool:
    """Insert keys in bulk; on False the table is as it was."""
    before = table.copy()
    mark, bucket = _place(table, keys)
    turn = np.random.default_rng(len(keys))
    for step in range(rounds):
        if not len(mark):
            return True
        order = np.argsort(bucket, kind="stable")
        mark, bucket = mark[order], bucket[order]
        rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        free = table[bucket] == 0
        fits = rank < free.sum(axis=1)
        slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
        table[bucket[fits], slot] = mark[fits]
        mark, bucket = mark[~fits], bucket[~fits]
        if step % 2 and len(mark):  # neither bucket had room: one key of each bucket changes places with a resident
            lead = np.unique(bucket, return_index=True)[1]
            slots = turn.integers(0, SLOTS, len(lead))
            evicted = table[bucket[lead], slots]
            table[bucket[lead], slots] = mark[lead]
            mark[lead] = evicted
        bucket = _other(table, mark, bucket)
    if len(mark):
        table[:] = before
    return not len(mark)


@dataclass(frozen=True)
class LineState:
    """Paths of one version of the index. Tables are only added, so a step that failed can be run again."""

    log: tuple[str, ...] = ()       # postings with sign +1 or -1
    counts: tuple[str, ...] = ()    # (k1, k2, n): changes of the exact reference counts
    ids: tuple[str, ...] = ()       # (doc_id, sign)
    filters: str | None = None      # (shard, tables): one row a shard


class LineIndex:
    """Lines of a growing set of documents, with exact reference counts.

    ``insert`` adds documents, ``delete`` takes them out again and undoes what they caused, ``apply`` drops repeated
    lines. A document is a doc_id; its repeated rows count once, rows without a doc_id or text are not indexed. Keys
    are told apart by 128 bits of hash. The filters hold the keys with a count above zero: a key of a new batch that
    its filter denies is new without a look into the count tables. A filter is a row of about ``shard_keys`` keys;
    the number of shards follows the first batch that has lines.
    """

    def __init__(self, spark: SparkSession, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 20_000):
        self.spark, self.min_chars, self.min_docs, self.shard_keys = spark, min_chars, min_docs, shard_keys
        self.shards = 0
        self.state = LineState()

    def _write(self, df: DataFrame, name: str) -> str:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        return path

    def _read(self, paths, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _log(self) -> DataFrame:
        """Postings of the documents now in the index."""
        log = self._read(self.state.log, f"{POSTING}, sign int")
        keys = ["doc_id", "tid", "pos", "k1", "k2"]
        if len(self.state.log) < 2:
            return log.select(*keys)
        return log.groupBy(*keys).agg(F.sum("sign").alias("n")).filter("n > 0").select(*keys)

    def counts(self) -> DataFrame:
        """Exact reference counts (k1, k2, n documents), n above zero."""
        counts = self._read(self.state.counts, "k1 long, k2 long, n long")
        if len(self.state.counts) < 2:
            return counts
        return counts.groupBy("k1", "k2").agg(F.sum("n").alias("n")).filter("n > 0")

    def ids(self) -> DataFrame:
        """Documents now in the index."""
        ids = self._read(self.state.ids, "doc_id long, sign int")
        return ids.groupBy("doc_id").agg(F.sum("sign").alias("n")).filter("n > 0").select("doc_id")

    def _by_shard(self, keys: DataFrame, run, schema: str) -> DataFrame:
        """Cogroup the filters with distinct keys (no hot group: a key is one row)."""
        shard = F.pmod(F.col("k2"), F.lit(self.shards)).cast("int")
        old = self._read([self.state.filters] if self.state.filters else [], "shard int, tables array<binary>")
        return old.groupBy("shard").cogroup(keys.withColumn("shard", shard).groupBy("shard")).applyInPandas(run, schema)

    def probe(self, keys: DataFrame) -> DataFrame:
        """Rows (k1, k2, maybe): false where the filters deny the key."""
        def run(old: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
            cuckoo = CuckooFilter.read(old["tables"].iloc[0]) if len(old) else CuckooFilter()
            marks = (batch["k1"] ^ batch["k2"]).to_numpy(np.int64)
            return batch[["k1", "k2"]].assign(maybe=cuckoo.contains(marks))

        return self._by_shard(keys.select("k1", "k2"), run, "k1 long, k2 long, maybe boolean")

    def _turn(self, keys: DataFrame, add: bool) -> str:
        """Path of the next version of the filters, with distinct keys put in or taken out."""
        def run(old: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
            cuckoo = CuckooFilter.read(old["tables"].iloc[0]) if len(old) else CuckooFilter()
            marks = (batch["k1"] ^ batch["k2"]).to_numpy(np.int64)
            (cuckoo.insert if add else cuckoo.delete)(marks)
            return pd.DataFrame({"shard": [(old if len(old) else batch)["shard"].iloc[0]], "tables": [cuckoo.write()]})

        return self._write(self._by_shard(keys.select("k1", "k2"), run, "shard int, tables array<binary>"), "line-filters")

    @staticmethod
    def _documents(rows: DataFrame) -> DataFrame:
        """Documents per key; two aggregates, so a line of every document is reduced before it meets itself."""
        return rows.select("k1", "k2", "doc_id").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n"))

    def insert(self, docs: DataFrame) -> None:
        """Add documents; those already in the index are left as they are."""
        ids = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        if self.state.ids:
            docs = docs.join(self.ids(), "doc_id", "left_anti")
            ids = ids.join(self.ids(), "doc_id", "left_anti")
        ids_path = self._write(ids.withColumn("sign", F.lit(1)), "line-ids")
        log = self._write(postings(docs, self.min_chars).withColumn("sign", F.lit(1)), "line-log")
        batch_path = self._write(self._documents(self._read([log], f"{POSTING}, sign int")), "line-counts")
        batch = self._read([batch_path], "k1 long, k2 long, n long")
        filters = self.state.filters
        if not self.shards:
            self.shards = -(-batch.count() // self.shard_keys)
        if self.shards:
            fresh = batch
            if filters:
                probed = self.probe(batch)
                known = self.counts().select("k1", "k2")
                fresh = probed.filter("NOT maybe").unionByName(
                    probed.filter("maybe").join(known, ["k1", "k2"], "left_anti"))
            filters = self._turn(fresh, add=True)
        old = self.state
        self.state = LineState(old.log + (log,), old.counts + (batch_path,), old.ids + (ids_path,), filters)

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents out (rows ``doc_id``; unknown ones are passed over); their lines lose their references."""
        gone = doc_ids.select("doc_id").distinct().join(self.ids(), "doc_id", "left_semi")
        ids_path = self._write(gone.withColumn("sign", F.lit(-1)), "line-ids")
        gone = self._read([ids_path], "doc_id long, sign int").select("doc_id")
        log = self._write(self._log().join(gone, "doc_id", "left_semi").withColumn("sign", F.lit(-1)), "line-log")
        lost = self._documents(self._read([log], f"{POSTING}, sign int"))
        batch_path = self._write(lost.withColumn("n", -F.col("n")), "line-counts")
        batch = self._read([batch_path], "k1 long, k2 long, n long")
        old = self.state
        after = LineState(old.log + (log,), old.counts + (batch_path,), old.ids + (ids_path,), old.filters)
        self.state = after
        filters = self._turn(batch.join(self.counts(), ["k1", "k2"], "left_anti"), add=False) if self.shards else None
        self.state = LineState(after.log, after.counts, after.ids, filters)

    def dropped(self) -> DataFrame:
        """Rows (doc_id, tid, drops): positions of the lines that go from each indexed row.

        A key held by ``min_docs`` documents or more stays only in the largest doc_id that holds it.
        """
        often = self.counts().filter(F.col("n") >= self.min_docs).select("k1", "k2")
        hits_path = self._write(self._log().join(often, ["k1", "k2"]), "line-hits")
        hits = self.spark.read.parquet(hits_path)
        keep = hits.groupBy("k1", "k2").agg(F.max("doc_id").alias("keep"))
        return (hits.join(keep, ["k1", "k2"]).filter(F.col("doc_id") < F.col("keep"))
                .groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("drops")))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` (indexed) with the repeated lines gone, and columns n_lines (before), n_dropped.

        A null text counts as one empty line and becomes empty. Rows, their order within a text and all other columns
        stay. Each row's drops are bounded by its own lines.
        """
        others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
        given = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
        drops = self.dropped().select(F.col("doc_id").alias("key"), F.col("tid").alias("text_key"), "drops")
        joined = given.join(
            drops, (F.col("row.doc_id") == F.col("key")) & (F.xxhash64("text") == F.col("text_key")), "left")
        lines = F.split("text", "\n")
        rows = joined.select("row", "text", F.size(lines).cast("long").alias("n_lines"), "drops",
                             F.when(F.col("drops").isNotNull(), lines).alias("lines"))
        stay = F.array_except(F.sequence(F.lit(1).cast("long"), F.col("n_lines")),
                              F.transform("drops", lambda p: p.cast("long") + 1))
        kept = F.array_join(F.transform(stay, lambda p: F.get(F.col("lines"), (p - 1).cast("int"))), "\n")
        text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept)
        columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c == "text" or c in others]
        return rows.select(*columns, "n_lines", F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Line dedup of one set of documents: an index of all of them, applied to all of them."""
    index = LineIndex(docs.sparkSession, min_chars, min_docs)
    index.insert(docs)
    return index.apply(docs)
