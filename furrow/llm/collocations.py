"""Phrase collocations of a corpus, counted in counting quotient filters that are merged across shards."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import quotient
from furrow.llm.numbering import numbered
from furrow.llm.wordchunks import MARK, chunks, counts, global_ids, with_ids
from furrow.session import materialise

_LETTERS = bytes(range(65, 91)), bytes(range(97, 123))
_SPLITS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_LETTERS[0] + b"\t" + _SPLITS, _LETTERS[1] + b" " + MARK * len(_SPLITS))
_MARKS = re.compile(re.escape(MARK) + b"+")
FLUSH = 1_000_000  # entries that a task holds before it sends its filters
PARTS = 32
SHARD = 1 << 20  # occurrences that a shard of the key space should hold; a task merges one in some 100 bytes each


def phrase_words(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only), with :data:`MARK` where a piece ends."""
    words = _MARKS.sub(b" " + MARK + b" ", text.translate(_FOLD)).split(b" ")
    return [*filter(None, words), MARK]


def grams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first, second and third ids (0: none) of all runs of two and three words; id 0 breaks a run."""
    a, b = ids[:-1], ids[1:]
    two = (a > 0) & (b > 0)
    three = two[:-1] & two[1:] if len(ids) > 2 else np.zeros(0, bool)
    at = np.flatnonzero(three)
    firsts, seconds = np.concatenate((a[two], ids[at])), np.concatenate((b[two], ids[at + 1]))
    return firsts, seconds, np.concatenate((np.zeros(int(two.sum()), ids.dtype), ids[at + 2]))


def filters(known: DataFrame, bits: int, shards: int) -> DataFrame:
    """Rows (shard, filter): one merged filter for each shard of the permuted key space that holds an n-gram.

    ``known`` is a chunk table with the global ``id`` of every word that counts. A task adds its n-grams up and sends
    a filter per shard when it holds :data:`FLUSH` entries, and at its end. Permuted keys are spread evenly, so an
    n-gram that fills the corpus is one counter per filter sent, and shards are of like size.
    """
    prefix = shards.bit_length() - 1

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[quotient.Entries] = []

        def send() -> pa.RecordBatch:
            left, right, times = quotient.tally(*(np.concatenate([h[k] for h in held]) for k in range(3)), bits)
            held.clear()
            tops = (left >> np.uint64(bits - prefix)).astype(np.int64)
            names, begin = np.unique(tops, return_index=True)
            end = [*begin[1:], len(tops)]
            packed = [quotient.encode((left[i:j], right[i:j], times[i:j]), bits, prefix) for i, j in zip(begin, end)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], ["shard", "filter"])

        for batch in batches:
            for row in range(batch.num_rows):
                ids = global_ids(batch, row)
                if len(ids) < 2:
                    continue
                first, second, third = grams(ids)
                left, right = quotient.permute(first, second << np.uint64(bits) | third, bits)
                held.append(quotient.tally(left, right, None, bits))
                if sum(len(h[0]) for h in held) >= FLUSH:
                    yield send()
        if sum(len(h[0]) for h in held):
            yield send()

    def join(shard: pa.Table) -> pa.Table:
        top = shard.column("shard")[0].as_py()
        whole = quotient.merge([f.as_py() for f in shard.column("filter")], bits, top)
        return pa.table({"shard": [top], "filter": pa.array([quotient.encode(whole, bits, prefix)], pa.binary())})

    parts = known.mapInArrow(fill, "shard long, filter binary")
    return parts.groupBy("shard").applyInArrow(join, "shard long, filter binary")


def counted(merged: DataFrame, bits: int, least: int = 1) -> DataFrame:
    """Rows (w1, w2, w3, a): the n-grams of :func:`filters` with a counter of ``least`` or more; w3 is 0 for two words."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("filter")):
                left, right, times = quotient.decode(data.as_py(), bits, shard)
                often = times >= least
                first, rest = quotient.permute(left[often], right[often], bits, back=True)
                low = np.uint64((1 << bits) - 1)
                columns = [first, rest >> np.uint64(bits), rest & low]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c.astype(np.int64)) for c in columns), pa.array(times[often])], ["w1", "w2", "w3", "a"])

    return merged.mapInArrow(read, "w1 long, w2 long, w3 long, a long")


def _score(a, left, right):
    """floor(1000000 * a * a / (left * right)) in decimal arithmetic."""
    big = [c.cast("decimal(15,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big[0] * big[0]), big[1] * big[2])


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words per language.

    A phrase occurs ``a`` times, ``least`` or more; its weakest cut has parts that occur l and r times. A phrase that
    lies in a longer candidate with at least ``share`` percent of its count is left out. ``n`` counts the words of the
    language. Null texts have no words, a null lang is ``und``; repeated rows count as often as they come; an empty
    table gives no rows; other columns are not read.

    Words below ``least`` cannot be part of a candidate, so they break runs and get no id; every other n-gram of the
    corpus is counted exactly. Ids reach the chunks of text by a join with their vocabularies.
    """
    group = F.coalesce("lang", F.lit("und"))
    chunked = materialise(chunks(docs, phrase_words, group, F.lit(True)), "phrase-chunks")
    words = materialise(counts(chunked), "phrase-words")
    ids = materialise(numbered(words.filter(F.col("f") >= least), ["grp", "word"], "id").withColumn("id", F.col("id") + 1), "phrase-ids")
    known, total = ids.count(), words.agg(F.sum("f")).first()[0] or 0
    bits = max(known.bit_length(), 1)
    shards = min(1 << max(2 * total // SHARD, 1).bit_length(), 1 << bits)
    found = materialise(counted(filters(with_ids(chunked, ids), bits, shards), bits, least), "phrases")

    def word(at: str):
        return ids.select(F.col("id").alias(at), F.col("f").alias(f"f_{at}"), F.col("word").alias(f"word_{at}"), F.col("grp").alias(f"lang_{at}"))

    two, three = found.filter("w3 = 0").drop("w3"), found.filter("w3 > 0")
    head = two.select("w1", "w2", F.col("a").alias("f_head"))
    tail = two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f_tail"))
    longest = three.select("w1", "w2", "a").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longest = longest.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    a, f1, f2, f3 = (F.col(c) for c in ("a", "f_w1", "f_w2", "f_w3"))
    pairs = two.join(longest, ["w1", "w2"], "left").filter("longer IS NULL OR 100 * longer < " + str(int(share)) + " * a")
    pairs = pairs.join(word("w1"), "w1").join(word("w2"), "w2").select(
        F.col("lang_w1").alias("lang"), F.concat_ws(" ", "word_w1", "word_w2").alias("phrase"), "a",
        f1.alias("l"), f2.alias("r"), _score(a, f1, f2).alias("score"))
    first, second = _score(a, f1, F.col("f_tail")), _score(a, F.col("f_head"), f3)
    triples = three.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).join(word("w1"), "w1").join(word("w2"), "w2").join(word("w3"), "w3")
    triples = triples.withColumns({"first": first, "second": second}).select(
        F.col("lang_w1").alias("lang"), F.concat_ws(" ", "word_w1", "word_w2", "word_w3").alias("phrase"), "a",
        F.when(F.col("first") <= F.col("second"), f1).otherwise(F.col("f_head")).alias("l"),
        F.when(F.col("first") <= F.col("second"), F.col("f_tail")).otherwise(f3).alias("r"),
        F.least("first", "second").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))  # a language is cut in parts first, so its last task sees PARTS * top rows
    best = pairs.unionByName(triples).withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    sizes = words.groupBy("grp").agg(F.sum("f").alias("n")).withColumnRenamed("grp", "lang")
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
