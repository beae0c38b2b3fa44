"""The words of a corpus as small integers in bounded chunks, each with a vocabulary of its own.

A corpus-wide value of a word (an id, a count) reaches the texts by a join with the vocabularies of the chunks, so a
word is one row per chunk however often it occurs, and nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import spread

MARK = b"\xff"  # never part of UTF-8 text; has the local id 0
CHUNK_WORDS = 1 << 18


class _Chunk:
    def __init__(self):
        self.vocabulary = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.vocabulary[MARK]
        self.parts, self.owners, self.counted, self.size = [], [], [], 0

    def add(self, words: list[bytes], owner, counted: bool) -> None:
        self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
        self.owners.append(owner)
        self.counted.append(counted)
        self.size += len(words)


def chunks(docs: DataFrame, tokens: Callable[[bytes], list[bytes]], group: Column, counted: Column,
           size: int = CHUNK_WORDS) -> DataFrame:
    """Rows (chunk, grp, words, n, marks, width, ids, doc_ids, ends, counted): whole texts of one group, ``size`` words or one text.

    ``tokens`` splits the UTF-8 bytes of a text into words and :data:`MARK`. ``ids`` holds local ids (``width`` bytes
    each, see :func:`packed`): 0 is the mark, k + 1 stands for ``words[k]``; ``n`` counts words (``marks`` the mark) in the texts where
    ``counted`` is true. Text k ends before ``ends[k]`` and belongs to ``doc_ids[k]``. A null text is empty, a null
    group is empty. ``chunk`` is unique in the result once that is written: write it before it is read twice.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                              F.coalesce(group, F.lit("")).alias("grp"), counted.alias("counted")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, open_ = TaskContext.get().partitionId(), 0, {}

        def close(name: str) -> pa.RecordBatch:
            nonlocal made
            own = open_.pop(name)
            ids = np.concatenate(own.parts) if own.parts else np.zeros(0, np.int32)
            lengths = np.array([len(p) for p in own.parts], np.int64)
            kept = ids[np.repeat(np.array(own.counted, bool), lengths)]
            n = np.bincount(kept, minlength=len(own.vocabulary)).astype(np.int64)
            width = 2 if len(own.vocabulary) <= 1 << 16 else 4
            words = pa.array(list(own.vocabulary)[1:], pa.binary()).cast(pa.string())
            row = [pa.array([(task << 33) + made], pa.int64()), pa.array([name], pa.string()), _list(words),
                   _list(pa.array(n[1:])), pa.array([int(n[0])], pa.int64()), pa.array([width], pa.int32()),
                   pa.array([packed(ids, width)], pa.binary()), _list(pa.array(own.owners, owner_type)),
                   _list(pa.array(np.cumsum(lengths))), _list(pa.array(own.counted, pa.bool_()))]
            made += 1
            return pa.RecordBatch.from_arrays(row, NAMES)

        for batch in batches:
            owner_type = batch.schema.field("doc_id").type
            for owner, text, name, flag in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "grp", "counted"))):
                chunk = open_.get(name)
                if chunk is None:
                    chunk = open_[name] = _Chunk()
                chunk.add(tokens(text.encode()), owner, bool(flag))
                if chunk.size >= size:
                    yield close(name)
                elif len(open_) > 4 and sum(c.size for c in open_.values()) >= 4 * size:
                    yield close(max(open_, key=lambda k: open_[k].size))
        for name in list(open_):
            yield close(name)

    return rows.mapInArrow(scan, f"chunk long, grp string, words array<string>, n array<long>, marks long, width int, "
                                 f"ids binary, doc_ids array<{kind}>, ends array<long>, counted array<boolean>")


NAMES = ["chunk", "grp", "words", "n", "marks", "width", "ids", "doc_ids", "ends", "counted"]


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def counts(chunked: DataFrame) -> DataFrame:
    """Rows (grp, word, f) of every word that is counted at least once."""
    each = chunked.select("grp", F.explode(F.arrays_zip("words", "n")).alias("w"))
    return each.filter("w.n > 0").groupBy("grp", F.col("w.words").alias("word")).agg(F.sum("w.n").alias("f"))


def with_ids(chunked: DataFrame, ids: DataFrame) -> DataFrame:
    """``chunked`` without words and n, and ``known``: one number for each word that ``ids`` (grp, word, id) holds.

    ``ids`` has one row per word, ids below 2 ** 35. The join sees a word once per chunk. See :func:`global_ids`.
    """
    words = chunked.select("chunk", "grp", F.posexplode("words").alias("at", "word"))
    code = F.shiftleft("id", 28) + F.col("at") + 1
    known = words.join(ids.select("grp", "word", "id"), ["grp", "word"]).groupBy("chunk").agg(F.collect_list(code).alias("known"))
    return chunked.drop("words", "n").join(known, "chunk", "left")


def packed(ids: np.ndarray, width: int) -> bytes:
    """Little-endian numbers of ``width`` bytes, compressed."""
    return pa.compress(ids.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, width: int, size: int) -> np.ndarray:
    """The ``size`` numbers of :func:`packed`."""
    return np.frombuffer(pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True), f"<u{width}")


def local_ids(row: pa.RecordBatch, at: int) -> np.ndarray:
    """Local ids of the chunk in row ``at`` of a batch."""
    ends = row.column("ends")[at].values
    return unpacked(row.column("ids")[at].as_py(), row.column("width")[at].as_py(), ends[len(ends) - 1].as_py())


def global_ids(row: pa.RecordBatch, at: int) -> np.ndarray:
    """The ids of :func:`with_ids` in the order of the text of the chunk in row ``at``; 0 where a word has none."""
    local, codes = local_ids(row, at), row.column("known")[at].values
    out = np.zeros(int(local.max(initial=0)) + 1, np.uint64)
    if codes is not None:
        codes = codes.to_numpy()
        out[codes & (1 << 28) - 1] = codes >> 28
    return out[local]
