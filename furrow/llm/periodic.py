"""Periodic runs of words: longest common extensions from a difference cover, on a harmonic grid."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import spread

# A perfect difference set; every difference modulo 31 lies between two of its members.
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)
CHUNK_WORDS = 400_000
QUERIES = 1_000_000  # extensions asked for at once


def _shifts() -> np.ndarray:
    """Per pair of residues, the least step after which both positions are sampled."""
    sampled = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    near = np.array([[sampled[r + d] for d in range(MODULUS)] for r in range(MODULUS)])
    return (near[:, None, :] & near[None, :, :]).argmax(axis=2)


SHIFT = _shifts()


class Extensions:
    """Longest common extensions of positions in a sequence of numbers whose last one is unique.

    Only suffixes that start at a residue of :data:`COVER` are sorted: word by word up to :data:`MODULUS` words, then
    by doubling over the samples of one residue. Two positions meet a pair of samples within fewer than
    :data:`MODULUS` words; from there the answer is a minimum over the common prefixes of neighbours in the order.
    """

    def __init__(self, words: np.ndarray):
        top = int(words.max(initial=0)) + 1
        self.words = np.concatenate((words, np.arange(top, top + MODULUS)))
        places = [np.arange(r, len(words), MODULUS) for r in COVER]
        self.base = np.full(MODULUS, -1)
        self.base[list(COVER)] = np.cumsum([0, *map(len, places)])[:-1]
        self.at = np.concatenate(places)
        self._sort(top + MODULUS)
        self._minima()

    def _sort(self, top: int) -> None:
        size = len(self.at)
        self.order, rank, prefix = np.arange(size), np.zeros(size, np.int64), np.full(size, -1, np.int64)
        open_ = np.arange(size)

        def refine(value: np.ndarray, bound: int, depth: int) -> None:
            """Split the groups at ``open_`` by the ``value`` of each member in order."""
            nonlocal open_
            own = self.order[open_]
            key = rank[own] * bound + value
            turn = np.argsort(key, kind="stable")
            own, key, old = own[turn], key[turn], rank[own[turn]]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            fresh = new & np.concatenate(([False], old[1:] == old[:-1]))
            self.order[open_] = own
            prefix[open_[fresh]] = depth
            rank[own] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
            alone = new & np.append(new[1:], True)
            open_ = open_[~alone]

        for depth in range(MODULUS):
            if len(open_) > 0:
                refine(self.words[self.at[self.order[open_]] + depth], top, depth)
        self.levels, step = [], 1
        while len(open_):
            self.levels.append(rank.copy())
            refine(self.levels[-1][self.order[open_] + step], size + 1, -1)
            step *= 2
        self.rank, self.prefix = rank, prefix
        late = np.flatnonzero(prefix[1:] < 0) + 1
        if len(late):
            prefix[late] = self._by_levels(self.order[late - 1], self.order[late])

    def _by_levels(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of samples that agree in their first :data:`MODULUS` words, from the classes of doubling."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.levels))):
            same = self.levels[level][a] == self.levels[level][b]
            out[same] += MODULUS << level
            a[same] += 1 << level
            b[same] += 1 << level
        return out + self._compare(self.at[a], self.at[b], np.full(len(a), MODULUS))[0]

    def _minima(self) -> None:
        table, width = [self.prefix], 1
        while 2 * width <= len(self.prefix):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.minima = table

    def _compare(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common words from i and j on, ``limit`` at most, and which pairs reached their limit."""
        out, reached = limit.copy(), np.ones(len(i), bool)
        left = np.flatnonzero(limit > 0)
        for step in range(int(limit.max(initial=0))):
            left = left[limit[left] > step]
            same = self.words[i[left] + step] == self.words[j[left] + step]
            out[left[~same]] = step
            reached[left[~same]] = False
            left = left[same]
            if not len(left):
                break
        return out, reached

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from ``i`` and ``j`` on, for arrays of different positions."""
        out, reached = self._compare(i, j, SHIFT[i % MODULUS, j % MODULUS])
        i, j, most = i[reached] + out[reached], j[reached] + out[reached], out[reached]
        a = self.rank[self.base[i % MODULUS] + i // MODULUS]
        b = self.rank[self.base[j % MODULUS] + j // MODULUS]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        least = np.empty(len(low), np.int64)
        for k in np.unique(level):
            own = level == k
            least[own] = np.minimum(self.minima[k][low[own]], self.minima[k][high[own] - (1 << int(k))])
        out[reached] = most + least
        return out


def find_runs(words: np.ndarray, ends: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs in texts that lie one after the other, longest text first.

    ``words`` holds a different negative number behind each text, at ``ends``. A run with period p covers two
    neighbours of the grid 0, p, 2p, ...: equal words there are extended to the right, and survivors are extended to
    the left by halving, which stays below p. Of several periods of one stretch the smallest is kept. ``times`` is 2
    at least.
    """
    if not len(words):
        return np.zeros((0, 3), np.int64)
    extend = Extensions(words - words.min())
    lengths = np.diff(ends, prepend=-1) - 1
    found, held, size = [], [], 0

    def settle() -> None:
        nonlocal size
        i, p = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        held.clear()
        size = 0
        reach = extend(i, i + p)
        long = reach >= np.maximum(least, times * p) - 2 * p + 1
        i, p, reach = i[long], p[long], reach[long]
        order = np.lexsort((i, i + reach, p))
        i, p, end = i[order], p[order], (i + reach)[order]
        first = np.ones(len(i), bool)
        first[1:] = (end[1:] != end[:-1]) | (p[1:] != p[:-1])
        i, p, end = i[first], p[first], end[first]
        low, high = np.zeros(len(i), np.int64), np.minimum(p - 1, i)
        while (low < high).any():
            middle = (low + high + 1) // 2
            some = np.flatnonzero(low < high)
            fits = extend(i[some] - middle[some], i[some] - middle[some] + p[some]) >= middle[some]
            low[some[fits]] = middle[some[fits]]
            high[some[~fits]] = middle[some[~fits]] - 1
        start = i - low
        found.append(np.stack((start, end + p - start, p), axis=1)[end + p - start >= np.maximum(least, times * p)])

    for p in range(1, int(lengths[0]) // times + 1):
        texts = int(np.searchsorted(-lengths, -max(least, times * p), side="right"))
        if not texts:
            break
        stop = int(ends[texts - 1])
        i = np.flatnonzero(words[0:stop - p:p] == words[p:stop:p]) * p
        if len(i):
            held.append((i, np.full(len(i), p)))
            size += len(i)
            if size >= QUERIES:
                settle()
    if held:
        settle()
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    kept = np.ones(len(runs), bool)
    kept[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[kept]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of a document of which one in ten, by its number, repeats a part of itself to its end."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _texts(some: list[list[bytes]], least: int, times: int) -> tuple[list[list[tuple]], list[bytes]]:
    """Runs (start, length, period) and collapsed text of each list of words."""
    order = sorted(range(len(some)), key=lambda k: -len(some[k]))
    vocabulary = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    lengths = np.array([len(some[k]) for k in order], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    joined = np.empty(int(lengths.sum()) + len(some), np.int64)
    for at, k in enumerate(order):
        joined[ends[at] - lengths[at]:ends[at]] = np.fromiter(map(vocabulary.__getitem__, some[k]), np.int64, len(some[k]))
    joined[ends] = -1 - np.arange(len(ends))
    found = find_runs(joined, ends, least, times)
    owner = np.searchsorted(ends, found[:, 0])
    runs, collapsed = [[] for _ in some], [b" ".join(words) for words in some]
    for at in np.unique(owner):
        own = found[owner == at] - [ends[at] - lengths[at], 0, 0]
        gone = np.zeros(int(lengths[at]) + 1, np.int64)
        np.add.at(gone, own[:, 0] + own[:, 2], 1)
        np.add.at(gone, own[:, 0] + own[:, 1], -1)
        keep = np.cumsum(gone)[:-1] == 0
        k = order[at]
        runs[k] = [tuple(r) for r in own.tolist()]
        collapsed[k] = b" ".join(some[k][w] for w in np.flatnonzero(keep).tolist())
    return runs, collapsed


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3,
                  arrange: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed): every whole text with its runs and without their repeats.

    Words are parted by ASCII white space. A run is a stretch with smallest period p, ``times`` * p and ``least``
    words or longer, that cannot grow; runs are structs (start, length, period) by start, then period. ``collapsed``
    joins by one blank the words that no run holds after its first period. ``arrange`` may replace a text's words
    before. A null or empty text has no words and an empty collapsed text; every row is a text of its own, also when
    doc_ids repeat or are null; an empty table gives no rows; other columns are not read. A task holds some hundred
    bytes for each word of about :data:`CHUNK_WORDS` words, or of one longer text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        owners, held, size = [], [], 0
        for batch in batches:
            type_ = batch.schema.field("doc_id").type

            def result() -> pa.RecordBatch:
                runs, collapsed = _texts(held, least, times)
                named = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
                out = pa.RecordBatch.from_arrays(
                    [pa.array(owners, type_), pa.array([len(w) for w in held], pa.int64()), pa.array(named, run),
                     pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                owners.clear()
                held.clear()
                return out

            for owner, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = text.encode().split()
                owners.append(owner)
                held.append(words if arrange is None else arrange(owner, words))
                size += len(held[-1]) + 1
                if size >= CHUNK_WORDS:
                    size = 0
                    yield result()
        if held:
            yield result()

    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def most_repeated(runs: Column) -> Column:
    """The run with the greatest exact length by period; the first of equal ones, null without runs."""
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def run_lines(runs: Column) -> Column:
    """Text of all runs, a line `start,length,period` each."""
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return F.array_join(line, "")
