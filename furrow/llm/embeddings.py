"""Near-duplicate vectors by spherical-cap filters from random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.graph import components
from furrow.session import materialise, spread


@dataclass(frozen=True)
class Caps:
    """Filter directions: every way to put one codeword into each block, after a random rotation.

    With ``blocks`` blocks of ``codewords`` random unit vectors there are codewords ** blocks directions, of which
    only the codewords are stored. A vector belongs to all directions with an inner product of ``height`` or more,
    and to its ``least`` best ones in any case. ``repeats`` such codes, independent of each other, are used at once.
    """

    codewords: int
    height: float
    blocks: int = 4
    least: int = 24
    seed: int = 42
    repeats: int = 1

    def codes(self, dim: int, nth: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rotation and codewords (blocks, codewords, block length) of the nth code for vectors of ``dim`` components."""
        rng = np.random.default_rng([self.seed + nth, dim, self.codewords])
        size = -(-dim // self.blocks)
        turn = np.linalg.qr(rng.standard_normal((size * self.blocks, size * self.blocks)))[0][:dim]
        words = rng.standard_normal((self.blocks, self.codewords, size))
        return turn, words / np.linalg.norm(words, axis=2, keepdims=True) / np.sqrt(self.blocks)


def caps_for(vectors: int, dim: int, directions: int = 64, bucket: float = 4.0, least: int = 24, cosine: float = 0.9,
             recall: float = 0.99, trials: int = 256) -> Caps:
    """Caps that hold about ``bucket`` of ``vectors`` unrelated vectors each, ``directions`` a vector and code.

    The share of the sphere in a cap falls with the number of vectors, so unrelated candidates grow in proportion to
    the vectors, not with their square. Narrower caps separate more of the near pairs, so both of the following are
    taken from ``trials`` random pairs with exactly the ``cosine``: the height at which a vector has ``directions`` of
    the code's own sums, and the number of independent codes that brings the share of pairs in a common cap to
    ``recall`` (the share of one code is taken a standard error lower).
    """
    share = min(0.05, bucket / max(1, vectors))
    words = max(6, int(np.ceil((directions / share) ** 0.25)))
    caps = Caps(words, 0.0, least=least)
    rng = np.random.default_rng([caps.seed, dim, words, trials])
    x = rng.standard_normal((trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    caps = replace(caps, height=_height(x[:64], caps, directions))
    if dim < 2 or cosine >= 1:
        return caps
    aside = rng.standard_normal((trials, dim))
    aside -= np.einsum("ij,ij->i", aside, x)[:, None] * x
    y = cosine * x + np.sqrt(1 - cosine ** 2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    met = np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(decode(x, caps), decode(y, caps))])
    met = max(0.05, met - np.sqrt(max(met * (1 - met), 1 / trials) / trials))
    return replace(caps, repeats=int(np.ceil(np.log(1 - recall) / np.log(1 - met))))


def _halves(unit: np.ndarray, caps: Caps, nth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each row the sums of all pairs of codewords of the first two blocks, and of the last two."""
    turn, words = caps.codes(unit.shape[1], nth)
    turned = (unit @ turn).reshape(len(unit), caps.blocks, words.shape[2])
    scores = np.einsum("nbs,bks->bnk", turned, words)
    return ((scores[0][:, :, None] + scores[1][:, None, :]).reshape(len(unit), -1),
            (scores[2][:, :, None] + scores[3][:, None, :]).reshape(len(unit), -1))


def _height(unit: np.ndarray, caps: Caps, directions: int) -> float:
    """The least height, to 20 bits, at which these rows have ``directions`` or fewer directions on average."""
    left, right = _halves(unit, caps)
    right = np.sort(-right, axis=1)
    low, high = -1.0, 1.0
    for _ in range(20):
        height = (low + high) / 2
        wanted = sum(int(np.searchsorted(r, ls[ls >= height + r[0]] - height, side="right").sum())
                     for ls, r in zip(left, right))
        low, high = (height, high) if wanted > directions * len(unit) else (low, height)
    return float(high)


def decode(unit: np.ndarray, caps: Caps) -> Iterator[np.ndarray]:
    """For each row the numbers of all directions above the height (or the best ``least`` of a code, if fewer are).

    The directions of the nth code follow those of the codes before it. As many rows are taken at once as leave the
    sums of a code at about two million.
    """
    step = max(1, 2_000_000 // caps.codewords ** 2)
    for at in range(0, len(unit), step):
        codes = [_decode(unit[at:at + step], caps, nth) for nth in range(caps.repeats)]
        for found in zip(*codes):
            yield np.concatenate([numbers + nth * caps.codewords ** caps.blocks for nth, numbers in enumerate(found)])


def _decode(unit: np.ndarray, caps: Caps, nth: int) -> Iterator[np.ndarray]:
    """The directions of one code.

    The blocks are joined to two halves; both halves' sums are sorted, and for each sum of the first half the second
    half is searched for the least partner that reaches the height, so only directions of the result are listed.
    """
    k = caps.codewords
    left, right = _halves(unit, caps, nth)
    left_order, right_order = np.argsort(-left, axis=1, kind="stable"), np.argsort(-right, axis=1, kind="stable")
    for row in range(len(unit)):
        lo, ro = left_order[row], right_order[row]
        ls, rs = left[row][lo], right[row][ro]
        use = np.searchsorted(-ls, rs[0] - caps.height, side="right")
        partners = np.searchsorted(-rs, ls[:use] - caps.height, side="right")
        if partners.sum() >= caps.least:
            first = np.repeat(np.arange(use), partners)
            second = np.arange(len(first)) - np.repeat(np.cumsum(partners) - partners, partners)
        else:
            few = min(caps.least, len(ls))
            sums = ls[:few, None] + rs[None, :few]
            best = np.argsort(-sums, axis=None, kind="stable")[: caps.least]
            first, second = np.divmod(best, few)
        yield lo[first].astype(np.int64) * (k * k) + ro[second]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not zero and has only finite components."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))


def classes(vectors: DataFrame) -> DataFrame:
    """Rows (rep, n, dim, embedding): one per different vector, with the smallest vec_id and the number of rows."""
    rows = usable(vectors).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select(
        "rep", "n", F.size("embedding").alias("dim"), "embedding")


def memberships(distinct: DataFrame, caps: dict[int, Caps]) -> DataFrame:
    """Rows (rep, dim, cap): the filter directions of every vector."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                reps, dims = some.column(0).to_numpy(), some.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    x = np.array(some.column(2).take(pa.array(own)).to_pylist(), np.float64)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    found = list(decode(unit, caps[dim]))
                    counts = [len(f) for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(reps[own], counts)), pa.array(np.full(sum(counts), dim, np.int32)),
                         pa.array(np.concatenate(found))], ["rep", "dim", "cap"])

    return spread(distinct.select("rep", "dim", "embedding")).mapInArrow(scan, "rep long, dim int, cap long")


def cell_pairs(start: np.ndarray, part: np.ndarray, across: np.ndarray, x: np.ndarray, rep: np.ndarray, cosine: float) -> np.ndarray:
    """Pairs (a, b), a < b, with the cosine or more, among rows of one cell; ``start`` numbers the cells in order.

    Row i is compared with rows i + 1, i + 2, ... while they are of its cell, all rows at once. In a cell that joins
    two parts of a bucket only pairs of different parts count.
    """
    found, step = [], 1
    alive = np.arange(len(rep))
    while True:
        alive = alive[alive + step < len(rep)]
        alive = alive[start[alive + step] == start[alive]]
        if not len(alive):
            break
        other = alive + step
        ok = ~across[alive] | (part[alive] != part[other])
        i, j = alive[ok], other[ok]
        near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        i, j = i[near], j[near]
        if len(i):
            found.append(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], axis=1))
        step += 1
    if not found:
        return np.empty((0, 2), np.int64)
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[pairs[:, 0] != pairs[:, 1]]


def link_vectors(distinct: DataFrame, cosine: float = 0.9, cell: int = 2_000, directions: int = 64) -> DataFrame:
    """Links (a, b), a < b, between different vectors that share a cap and have the cosine or more (double precision).

    A bucket of more than ``cell`` vectors is dealt into parts of about that many; every two parts meet in a cell of
    their own, so no pair is left out and no task holds more than two parts.
    """
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    caps = {dim: caps_for(n, dim, directions, cosine=cosine) for dim, n in sizes.items()}
    found = materialise(memberships(distinct, caps), "caps")
    buckets = found.groupBy("dim", "cap").agg(F.count("*").alias("size")).filter("size > 1")
    rows = found.join(buckets, ["dim", "cap"])
    parts = F.ceil(F.col("size") / cell).cast("int")
    rows = rows.select("dim", "cap", "rep", parts.alias("parts"), F.pmod(F.xxhash64("rep", F.lit(7)), parts).cast("int").alias("part"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("dim", "cap", "rep", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    vectors = distinct.select("rep", "embedding")
    rows = rows.join(vectors, "rep").select("dim", "cap", "low", "high", "part", "rep", "embedding")
    keys = ["dim", "cap", "low", "high"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def out(rows: pa.Table) -> pa.RecordBatch:
            start, across = _starts(rows), rows["low"].to_numpy() != rows["high"].to_numpy()
            dims, pairs = rows["dim"].to_numpy(), []
            part, rep = rows["part"].to_numpy(), rows["rep"].to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = np.array(rows["embedding"].take(pa.array(own)).combine_chunks().flatten()).reshape(-1, dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                pairs.append(cell_pairs(start[own], part[own], across[own], x, rep[own], cosine))
            both = np.concatenate(pairs)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        def _starts(rows: pa.Table) -> np.ndarray:
            fresh = np.zeros(len(rows), bool)
            for key in keys:
                values = rows[key].to_numpy()
                fresh[1:] |= values[1:] != values[:-1]
            return np.cumsum(fresh)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            if not len(rows):
                continue
            start = _starts(rows)
            cut = int(np.searchsorted(start, start[-1]))
            waiting = rows.slice(cut)
            if cut:
                yield out(rows.slice(0, cut))
        if waiting is not None and len(waiting):
            yield out(waiting)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(scan, "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, directions: int = 64) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of different
    length are not compared. Equal vectors are one class: all its rows link with each other and with the rows of
    linked classes, and are never paired. ``n_links`` counts linked rows; ``component_id`` is the smallest vec_id
    reachable; ``kept`` marks the row that bears it. Only verified pairs are linked; a pair that shares no cap is
    missed (measured recall: README). Other columns, labels included, are not read.
    """
    distinct = materialise(classes(vectors), "vectors")
    links = materialise(link_vectors(distinct, cosine, directions=directions), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = distinct.select(F.col("rep").alias("b"), F.col("n").alias("m"))
    partners = both.join(sizes, "b").groupBy("a").agg(F.sum("m").alias("partners"))
    roots = components(links, "a", "b")
    stats = distinct.join(partners, distinct["rep"] == partners["a"], "left").join(
        roots, distinct["rep"] == roots["node"], "left").select(
        "embedding", (F.coalesce("partners", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    stats = materialise(stats, "classes").withColumnRenamed("embedding", "key")
    given = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    joined = given.join(stats, F.col("embedding") == F.col("key"), "left")
    component = F.coalesce("root", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
