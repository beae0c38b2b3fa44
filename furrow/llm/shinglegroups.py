"""Near-duplicates by the similarity of their five-word shingles, found by SimHash balls and verified exactly.

The meet-in-the-middle of :mod:`simhash` with a radius that reaches a similarity of 0.8: each of several short sketches
emits all variants within half the radius 2, colliding texts are compared by a further fingerprint of 64 bits, and
the clusters of what passes are verified on the shingles themselves, where their texts lie together.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.graph import components
from furrow.session import materialise, spread

WORDS = 5
SIMILARITY = 0.8
SEED = 42
FAR = 20  # differing bits of 64 beyond which a pair is not verified: 3.6 standard deviations over those at 0.8
BLOCK = 1024
SMALL = 64  # members of a bucket of which all pairs are taken at once
CELL_ROWS, CELL_BYTES = 1_000, 8_000_000  # texts and bytes of a side of a cell
SIDES = 24  # up to which a cluster is dealt to smaller sides of SMALL texts, so that many tasks share it


def shingles(text: bytes, words: int = WORDS) -> list[bytes]:
    """Different shingles of a text: runs of ``words`` words (A-Z in lower case) joined by a blank; a shorter text is one."""
    found = text.lower().split()
    if len(found) < words:
        return [b" ".join(found)] if found else []
    return list({b" ".join(found[k:k + words]) for k in range(len(found) - words + 1)})


def similarity(one: bytes, other: bytes, words: int = WORDS) -> float:
    """Shared shingles by all shingles; texts without a word are equal."""
    a, b = set(shingles(one, words)), set(shingles(other, words))
    return len(a & b) / len(a | b) if a or b else 1.0


def plan(texts: int, recall: float = 0.92, least: float = SIMILARITY) -> tuple[int, int]:
    """Bits and number of the sketches, so that pairs at ``least`` meet with probability ``recall``.

    A bit differs with probability q = angle / pi; two sketches meet where at most two bits differ. Sketches grow with
    the logarithm of the number of texts, so that chance meetings per text do not grow.
    """
    q = acos(2 * least / (1 + least)) / pi
    bits = max(24, ceil(log2(max(texts, 2))) + 6)
    meet = sum(comb(bits, k) * q**k * (1 - q) ** (bits - k) for k in range(3))
    return bits, ceil(log(1 - recall) / log(1 - meet))


def _hashes(text: bytes, words: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, words)], np.uint64)


def _sketch(text: bytes, bits: int, tables: int, words: int) -> np.ndarray:
    """The fingerprint, then the sketches: majorities of the bits of mixed hashes of the different shingles."""
    return _majorities(_hashes(text, words), bits, tables)


def _majorities(base: np.ndarray, bits: int, tables: int) -> np.ndarray:
    if not len(base):
        return np.zeros(tables + 1, np.int64)
    need = 1 + -(-bits * tables // 64)
    with np.errstate(over="ignore"):
        mixed = base[:, None] + np.arange(need, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
    ones = np.zeros(64 * need, np.int64)
    for at in range(0, len(mixed), 4096):
        ones += np.unpackbits(mixed[at:at + 4096].astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    major = ones * 2 > len(mixed)
    first = np.packbits(major[:64], bitorder="little").view("<i8")
    rest = major[64:64 + bits * tables].reshape(tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return np.concatenate((first, rest))


def sketches(docs: DataFrame, bits: int, tables: int, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, tid, sid, fp, sketch), one per input row: ``tid`` hashes the text, ``sid`` its set of shingles, ``fp``
    is its fingerprint."""
    rows = spread(docs.select("doc_id", F.xxhash64("text").alias("tid"), F.col("text").cast("binary").alias("text")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_hashes(t.as_py() or b"", words) for t in batch.column(2)]
            sets = np.array([h.sum(dtype=np.uint64) for h in hashes], np.uint64).view(np.int64)
            found = [_majorities(h, bits, tables) for h in hashes]
            table = np.stack(found) if found else np.zeros((0, tables + 1), np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(table[:, 1:].reshape(-1)), tables).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sets), pa.array(table[:, 0]), lists], ["doc_id", "tid", "sid", "fp", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, tid long, sid long, fp long, sketch array<long>")


def _variants(nodes: DataFrame, bits: int) -> DataFrame:
    """Rows (part, variant, fp, tid): every sketch of a node and all its variants of one bit."""
    flips = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(bits)]])
    each = nodes.select("fp", "tid", F.posexplode("sketch").alias("part", "code"))
    return each.select(F.col("part").cast("tinyint").alias("part"), "code", "fp", "tid", F.explode(flips).alias("flip")).select(
        "part", F.col("code").bitwiseXOR(F.col("flip")).alias("variant"), "fp", "tid")


def bucket_pairs(run: np.ndarray, fp: np.ndarray, name: np.ndarray | None = None) -> np.ndarray:
    """Rows (a, b) of members, by ``name`` (None: by fingerprint): all pairs within :data:`FAR` bits of one run of up to :data:`SMALL` members, a star of larger ones.

    Arrays are sorted by (run, fp). In a larger run each member is paired with the smallest near one that comes before it;
    the pairs this leaves are those of :func:`other_pairs`, which is asked for what the stars did not join.
    """
    name = fp if name is None else name
    found, size = [np.empty((0, 2), np.int64)], np.bincount(run)
    index = np.flatnonzero((size[run] <= SMALL) & (size[run] > 1))
    for step in range(1, SMALL):
        index = index[index + step < len(run)]
        index = index[run[index + step] == run[index]]
        if not len(index):
            break
        near = index[np.bitwise_count((fp[index] ^ fp[index + step]).view(np.uint64)) <= FAR]
        found.append(np.stack((name[near], name[near + step]), axis=1))
    for large in np.flatnonzero(size > SMALL):
        left, names = fp[run == large], name[run == large]
        for at in range(0, len(left), BLOCK):
            own = left[at:at + BLOCK]
            open_ = np.arange(len(own))  # without a partner so far
            for before in range(0, at + BLOCK, BLOCK):
                other = left[before:before + BLOCK]
                near = np.bitwise_count((own[open_, None] ^ other[None, :]).view(np.uint64)) <= FAR
                if before == at:
                    near &= np.arange(len(other))[None, :] < open_[:, None]
                hit = near.any(axis=1)
                found.append(np.stack((names[before + near.argmax(axis=1)[hit]], names[at + open_[hit]]), axis=1))
                open_ = open_[~hit]
                if not len(open_):
                    break
    pairs = np.concatenate(found)
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def other_pairs(fp: np.ndarray, name: np.ndarray, root: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (a, b) of all pairs of one run within :data:`FAR` bits whose roots differ, block against block."""
    for at in range(0, len(fp), BLOCK):
        for before in range(0, at + 1, BLOCK):
            own, other = slice(at, at + BLOCK), slice(before, before + BLOCK)
            near = np.bitwise_count((fp[own, None] ^ fp[None, other]).view(np.uint64)) <= FAR
            near &= root[own, None] != root[None, other]
            right, left = np.nonzero(np.tril(near, -1) if at == before else near)
            if len(right):
                yield np.stack((name[before + left], name[at + right]), axis=1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of a partition sorted by its first two columns; the last run waits for the next batch."""
    waiting: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        one, two = columns[:2]
        last = np.flatnonzero((one != one[-1]) | (two != two[-1]))
        same = waiting and one[0] == waiting[-1][0][-1] and two[0] == waiting[-1][1][-1]
        if waiting and not same:
            yield [np.concatenate(c) for c in zip(*waiting)]
            waiting = []
        if len(last):
            cut = last[-1] + 1
            yield [np.concatenate(c) for c in zip(*waiting, [c[:cut] for c in columns])]
            waiting, columns = [], [c[cut:] for c in columns]
        waiting.append(columns)
    if waiting:
        yield [np.concatenate(c) for c in zip(*waiting)]


def _numbers(columns: list[np.ndarray]) -> np.ndarray:
    one, two = columns[:2]
    return np.cumsum(np.concatenate(([False], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))


def joined(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Labels after the links of ``pairs`` (rows of places): the smallest place reachable; ``label`` is such an array before."""
    label = label.copy()
    while True:
        one, two = label[pairs[:, 0]], label[pairs[:, 1]]
        apart = one != two
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (label[label] != label).any():
            label = label[label]


def forest(run: np.ndarray, fp: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Rows (a, b) of roots: what pairs within :data:`FAR` bits of one run join, as fewer rows than there are roots.

    Arrays are sorted by (run, fp). Runs of one root add nothing and are not compared.
    """
    begin = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    mixed = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
    kept = np.repeat(mixed, np.diff(np.append(begin, len(run))))
    run, fp = run[kept], fp[kept]
    names, own = np.unique(root[kept], return_inverse=True)
    label = joined(np.arange(len(names)), own[bucket_pairs(run, fp, np.arange(len(run)))])
    for large in np.flatnonzero(np.bincount(run) > SMALL):
        i, j = np.searchsorted(run, (large, large + 1))
        now = label[own[i:j]]  # read block by block, so later blocks see what earlier ones joined
        for pairs in other_pairs(fp[i:j], np.arange(i, j), now):
            label = joined(label, own[pairs])
            now[:] = label[own[i:j]]
    moved = label != np.arange(len(names))
    return np.stack((names[label[moved]], names[moved]), axis=1)


def _joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`forest` of a partition of (part, variant, fp, root) sorted by (variant, part, fp)."""
    for columns in _runs(batches):
        links = forest(_numbers(columns), *columns[2:])
        if len(links):
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def cell_links(fp: np.ndarray, sketch: np.ndarray, side: np.ndarray, texts: list[bytes], words: int = WORDS,
               least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (places a < b) with the components of all near pairs of a cell whose texts have the similarity ``least``.

    Near pairs lie within :data:`FAR` bits and share a variant of a sketch, or have one fingerprint. In a cell of two sides pairs
    of one side are left to that side's own cell. Hashed shingles are counted for all pairs not joined so far; what
    passes is compared itself.
    """
    hashes = [_hashes(t, words) for t in texts]
    size = np.array([len(h) for h in hashes])
    ids = np.unique(np.concatenate(hashes), return_inverse=True)[1]
    ends = np.cumsum(size)
    shingle = np.split(ids, ends[:-1])
    mark, label, links = np.zeros(len(ids), bool), np.arange(len(texts)), []
    cross = (side != side[0]).any()
    for k in range(1, len(texts)):
        at = np.flatnonzero((label[:k] != label[k]) & (np.bitwise_count((fp[:k] ^ fp[k]).view(np.uint64)) <= FAR))
        at = at[np.minimum(size[at], size[k]) / np.maximum(np.maximum(size[at], size[k]), 1) >= least]
        if cross:
            at = at[side[at] != side[k]]
        if len(at):
            at = at[(np.bitwise_count(sketch[at] ^ sketch[k]) <= 2).any(axis=1) | (fp[at] == fp[k])]
        if not len(at):
            continue
        mark[shingle[k]] = True
        owner = np.repeat(np.arange(len(at)), size[at])
        shared = np.bincount(owner[mark[np.concatenate([shingle[x] for x in at])]], minlength=len(at))
        mark[shingle[k]] = False
        for x in at[shared / (size[at] + size[k] - shared) >= least].tolist():
            if label[x] != label[k] and similarity(texts[x], texts[k], words) >= least:
                links.append((x, k))
                label[label == label[k]] = label[x]
    return links


def _cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole cells of a partition sorted by its first ``keys`` columns, one at a time."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:keys]])
        begin = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        for i, j in zip(begin, [*begin[1:], batch.num_rows]):
            if waiting and last != tuple(key[:, i]):
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(i, j - i))
            last = tuple(key[:, i])
    if waiting:
        yield pa.Table.from_batches(waiting)


def _dealt(members: DataFrame) -> DataFrame:
    """Members (root, tid, fp, sketch, text) with the cells (one, two) of their cluster and their own ``side``.

    A cluster of up to :data:`SMALL` texts is one cell. A larger one is dealt to :data:`SIDES` sides or fewer by a hash of the
    text, to more where a side would pass :data:`CELL_ROWS` texts or :data:`CELL_BYTES`, and each side meets itself and
    every other in a cell of their own. A text is copied once a side.
    """
    n, size = F.count("*"), F.octet_length("text")
    sides = members.groupBy("root").agg(
        F.ceil(F.greatest(F.least(n / SMALL, F.lit(float(SIDES))), n / CELL_ROWS, F.sum(size) / CELL_BYTES)).cast("int").alias("sides"))
    side = F.pmod(F.xxhash64("tid", F.lit(SEED)), F.col("sides")).cast("int")
    each = members.join(sides, "root").withColumn("side", side).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    return each.select("root", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "side",
                       "tid", "fp", "sketch", "text")


def _verified(cells: DataFrame, parts: int, words: int, least: float) -> DataFrame:
    """Rows (a, b) of text hashes: :func:`cell_links` of every cell, fewer than the cell has texts."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, 3):
            tid, fp, side = (cell[c].to_numpy() for c in ("tid", "fp", "side"))
            sketch = cell["sketch"].combine_chunks().flatten().to_numpy().reshape(len(tid), -1)
            links = cell_links(fp, sketch, side, cell["text"].to_pylist(), words, least)
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(tid[a]), pa.array(tid[b])], ["a", "b"])

    keys = ["root", "one", "two"]
    return cells.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def groups(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, tid, root): the group of every row; rows are linked by texts of ``least`` similarity or more.

    Texts with the same shingles are one node, without a word too; a null text is empty. Nodes that meet in a bucket and
    are near lie in one cluster: buckets of equal sketches join nodes first, buckets of variants then join clusters, both
    by forests, whose rows grow with the nodes and not with their pairs. Each cluster's near pairs are verified on the
    texts where these lie together, so no row is made for a pair; every near pair is either verified itself or already
    joined by verified ones.
    """
    bits, tables = plan(docs.count())
    prints = materialise(sketches(docs, bits, tables, words), "sketches")
    nodes = materialise(prints.groupBy("sid").agg(
        F.min("tid").alias("tid"), F.min("fp").alias("fp"), F.min_by("sketch", "tid").alias("sketch")), "nodes")
    rows = nodes.count() * tables * (bits + 1)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 4_000_000 + 1)

    def meet(buckets: DataFrame) -> DataFrame:
        dealt = buckets.repartition(parts, "variant").sortWithinPartitions("variant", "part", "fp")
        return dealt.mapInArrow(_joins, "a long, b long")

    same = nodes.select("fp", F.col("tid").alias("b")).join(nodes.groupBy("fp").agg(F.min("tid").alias("a")), "fp")
    equal = nodes.select("fp", "tid", F.posexplode("sketch").alias("part", "variant")).select(
        F.col("part").cast("tinyint").alias("part"), "variant", "fp", "tid")
    links = materialise(meet(equal).unionByName(same.filter("a <> b").select("a", "b")), "equal")
    roots = components(links, "a", "b").withColumnsRenamed({"node": "tid"})
    rooted = nodes.join(roots, "tid", "left").select("sid", "fp", F.coalesce("root", "tid").alias("tid"), "sketch")
    rooted = rooted.repartition(max(parts // 4, 1), "sid")  # a node becomes hundreds of rows
    clusters = components(materialise(links.unionByName(meet(_variants(rooted, bits))), "met"), "a", "b")
    members = nodes.select("tid", "fp", "sketch").join(clusters.withColumnsRenamed({"node": "tid"}), "tid")
    texts = docs.select(F.xxhash64("text").alias("tid"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    texts = texts.join(members.select("tid"), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    members = materialise(members.join(texts, "tid"), "members")
    roots = components(_verified(_dealt(members), parts, words, least), "a", "b")
    own = nodes.select("sid", F.col("tid").alias("node")).join(roots, "node", "left").select(
        "sid", F.coalesce("root", "node").alias("root"))
    return prints.select("doc_id", "tid", "sid").join(own, "sid").select("doc_id", "tid", "root")


def keep_one(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of :func:`groups`: the one with the smallest doc_id (nulls last).

    All columns stay. Of repeated rows of that document one stays. An empty table stays empty.
    """
    first = groups(docs, words, least).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("one"))
    first = first.select(F.col("one.doc_id").alias("_id"), F.col("one.tid").alias("_tid"))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    given = given.select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("tid"))
    kept = given.join(first, given["doc_id"].eqNullSafe(first["_id"]) & (given["tid"] == first["_tid"]))
    nth = F.row_number().over(Window.partitionBy("doc_id", "tid").orderBy(F.lit(0)))
    return kept.withColumn("nth", nth).filter("nth = 1").select(*[F.col(f"row.`{c}`") for c in docs.columns])
