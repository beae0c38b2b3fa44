"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.graph import components
from furrow.session import materialise, spread

BITS = 64
RADIUS = 3
PARTS = 4  # blocks of 16 bits
WIDTH = BITS // PARTS
VARIANTS = PARTS * (1 + BITS - WIDTH)
VARIANTS_A_TASK = 4_000_000


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one text, as a signed integer; see :func:`fingerprints`."""
    found = text.lower().split()
    if not found:
        return 0
    joined, n = b" ".join(found), len(found)
    if n < words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[: n - words + 1].tolist(), ends[words - 1:].tolist())]
    return _majority(np.array(hashes, np.uint64))


def _majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(octets) < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _OCTET_BITS for k in range(8)])
    bits = np.packbits(ones * 2 > len(octets), bitorder="little")
    return int(bits.view("<i8")[0])


_OCTET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Rows (doc_id, tid, fp long): the SimHash of every whole text; ``tid`` hashes the text.

    A-Z are lower-cased; words are runs without the six ASCII white-space characters; shingles are ``words`` words
    joined by a space, repeats included; a shorter text is one shingle; a null text or one without a word has
    fingerprint 0. Hash: XXH64 of the UTF-8 bytes with seed 42. A bit is 1 if set in over half of the hashes.
    One row per input row; other columns of ``docs`` are not read.
    """
    rows = spread(docs.select("doc_id", F.xxhash64("text").alias("tid"), F.col("text").cast("binary").alias("text")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", words) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], ["doc_id", "tid", "fp"])

    return rows.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tid long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def variants(fps: DataFrame) -> DataFrame:
    """Rows (part, variant, fp): for every blanked block, all variants of a fingerprint within one bit elsewhere.

    Half of the radius 3 is one bit and a remainder of one. The remainder is met by blanking: two fingerprints within
    three bits differ in at most two bits outside some block, so after blanking it their balls of radius one meet.
    A fingerprint emits 4 * (1 + 48) = 196 rows, whatever the corpus.
    """
    moves = []
    for part in range(PARTS):
        blank = ((1 << WIDTH) - 1) << (part * WIDTH)
        flips = [0] + [1 << bit for bit in range(BITS) if not blank >> bit & 1]
        moves += [F.struct(F.lit(part).cast("tinyint").alias("part"), F.lit(_signed(~blank & (1 << 64) - 1)).alias("keep"),
                           F.lit(_signed(flip)).alias("flip")) for flip in flips]
    spun = fps.select("fp", F.explode(F.array(*moves)).alias("m"))
    return spun.select(
        F.col("m.part").alias("part"),
        F.col("fp").bitwiseXOR(F.col("m.flip")).bitwiseAND(F.col("m.keep")).alias("variant"), "fp")


_THREES = np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), 3)], np.int64)


def run_links(part: np.ndarray, variant: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links that connect all fingerprints within three bits of each other that share a variant; rows (a, b).

    Arrays are sorted by (variant, part). Members of a run lie within one bit of the variant outside the blanked
    block. Members that agree in the block differ in at most two bits: each links to the smallest of them. Blocks one
    bit apart make at most three bits: their smallest members link. Blocks three bits apart link where nothing else
    differs. Any other pair within three bits meets these cases in another run, so no connection is lost, while a run
    of n members gives O(n) links. A run has at most 49 * 65,536 members, whatever the corpus.
    """
    same = np.zeros(len(fp), bool)
    same[1:] = (variant[1:] == variant[:-1]) & (part[1:] == part[:-1])
    shared = same.copy()
    shared[:-1] |= same[1:]
    if not shared.any():
        return np.empty((0, 2), np.int64)
    run = np.cumsum(~same)[shared]
    run = np.unique(run, return_inverse=True)[1].astype(np.int64)
    part, variant, fp = part[shared].astype(np.int64), variant[shared], fp[shared]
    block = (fp >> (part * WIDTH)) & ((1 << WIDTH) - 1)
    code = (run << WIDTH) | block
    order = np.lexsort((fp, code))
    code, fp, variant, part = code[order], fp[order], variant[order], part[order]
    groups, first = np.unique(code, return_index=True)
    found = [np.stack([fp[first][np.searchsorted(groups, code)], fp], axis=1)]

    def partners(codes: np.ndarray, least: np.ndarray, mask: int) -> None:
        other = codes ^ mask
        at = np.minimum(np.searchsorted(codes, other), len(codes) - 1)
        hit = (codes[at] == other) & (other > codes)
        if hit.any():
            found.append(np.stack([least[hit], least[at[hit]]], axis=1))

    for bit in range(WIDTH):
        partners(groups, fp[first], 1 << bit)
    exact = (fp ^ variant) & ~(((1 << WIDTH) - 1) << (part * WIDTH)) == 0
    if exact.sum() > 1:
        codes, at = np.unique(code[exact], return_index=True)
        pairs = np.unique(codes >> WIDTH, return_counts=True)
        several = np.isin(codes >> WIDTH, pairs[0][pairs[1] > 1])
        codes, least = codes[several], fp[exact][at][several]
        if len(codes):
            for mask in _THREES.tolist():
                partners(codes, least, mask)
    links = np.concatenate(found)
    near = np.bitwise_count((links[:, 0] ^ links[:, 1]).view(np.uint64)) <= RADIUS
    links = links[near & (links[:, 0] != links[:, 1])]
    return np.unique(links, axis=0) if len(links) else links


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by variant; the last run waits for the next batch."""
    waiting: list[np.ndarray] | None = None

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        links = run_links(*columns)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if waiting is not None:
            columns = [np.concatenate(pair) for pair in zip(waiting, columns)]
        if not len(columns[0]):
            continue
        part, variant, _ = columns
        last = np.flatnonzero((variant != variant[-1]) | (part != part[-1]))
        cut = last[-1] + 1 if len(last) else 0
        waiting = [c[cut:] for c in columns]
        if cut:
            yield out([c[:cut] for c in columns])
    if waiting is not None and len(waiting[0]):
        yield out(waiting)


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints within three bits, enough to give the components of all of them.

    Fingerprints are small and their variants are not, so they are dealt by the number of rows that they become: a
    task emits about ``VARIANTS_A_TASK``, however few bytes its input has.
    """
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, -(-fps.count() * VARIANTS // VARIANTS_A_TASK))
    dealt = variants(fps.select("fp").repartition(tasks, "fp").distinct())
    dealt = dealt.repartition("variant").sortWithinPartitions("variant", "part")
    return dealt.mapInArrow(_colliding, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """Rows (doc_id, tid, fp, root, component_id): the group of every document, by fingerprints at most 3 bits apart.

    ``component_id`` is the smallest doc_id reachable, ``root`` the group's smallest fingerprint. Equal fingerprints
    (equal texts, all texts without a word) are one node, so groups of copies are never paired. Rows without a doc_id
    get the group of their fingerprint, with a null component_id if no row of it has a doc_id. Repeated rows stay. An
    empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, words), "fingerprints")
    least = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(link_fingerprints(least), "a", "b")
    named = least.join(roots, least["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "nodes")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = named.join(groups, "root").select("fp", "root", "component_id")
    return fps.join(groups, "fp").select("doc_id", "tid", "fp", "root", "component_id")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest doc_id (nulls last).

    All columns stay. Of repeated rows of that document one stays.
    """
    found = near_duplicates(docs, words)
    first = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("one"))
    first = first.select(F.col("one.doc_id").alias("_id"), F.col("one.tid").alias("_tid"))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    given = given.select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("tid"))
    kept = given.join(first, given["doc_id"].eqNullSafe(first["_id"]) & (given["tid"] == first["_tid"]))
    nth = F.row_number().over(Window.partitionBy("doc_id", "tid").orderBy(F.lit(0)))
    return kept.withColumn("nth", nth).filter("nth = 1").select(*[F.col(f"row.`{c}`") for c in docs.columns])
