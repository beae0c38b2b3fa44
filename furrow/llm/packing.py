"""Packing of documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.numbering import numbered
from furrow.session import materialise, spread

# Fixed value: the split rule of the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@cache
def encoder(path: str):
    """Encoder of a byte-level BPE file; ``encode`` with all special tokens allowed is the library's default call.

    The ids equal those of the file's own library (tests compare them); the merge order of such a file is its id
    order, so the ranks can be read off the vocabulary, which encodes several times faster.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters, special = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, width: int = 4) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, ids): every document's tokens and ``end_id``, cut at full windows.

    ``ids`` holds little-endian unsigned integers of ``width`` bytes. ``path`` is the vocabulary file, present on every node. A
    null or empty text is its end id alone. Every row of ``docs`` is a document of its own, also when doc_ids repeat.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoder(path).encode, allowed_special="all")
        names = ["doc_id", "start", "length", "doc_tokens", "ids"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                owner, start, length, total, ids = [], [], [], [], []
                for row, text in enumerate(some.column(1)):
                    tokens = np.array(encode(text.as_py()) + [end_id], f"<u{width}").tobytes()
                    for begin in range(0, len(tokens), width * window):
                        part = tokens[begin:begin + width * window]
                        owner.append(row)
                        start.append(begin // width)
                        length.append(len(part) // width)
                        total.append(len(tokens) // width)
                        ids.append(part)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names)

    return rows.mapInArrow(scan, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths (length: times, within ``counts``) whose sum comes closest to ``room`` from below.

    A bitset holds the sums that are reachable; each step adds one chunk of equal lengths (binary split of its count),
    long ones first, until ``room`` is reached. The chunks are then traced back.
    """
    reach, steps, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, chunk = left - take, chunk * 2
            if reach & goal:
                break
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length: times) with how many sequences follow each; together they hold every piece once.

    The longest piece left opens a sequence, and :func:`fill` finds the multiset with the least slack beside it. A
    pattern is repeated while the counts allow. The work depends on the window, not on the number of pieces.
    """
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if v > (k == longest)}
        pattern = fill(rest, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def places(counts: dict[int, int], window: int) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, times per sequence, first sequence, first offset), by first rank."""
    rank, sequence, out = dict.fromkeys(counts, 0), 0, {}
    for pattern, times in plan(counts, window):
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.setdefault(length, []).append((rank[length], n, sequence, offset))
            rank[length] += n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(cut: DataFrame, window: int = 1024, width: int = 4, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``cut`` (with piece, length of at most ``window`` and ``order``) with columns sequence_id and offset for ``piece``.

    ``piece`` numbers the rows uniquely. Only the histogram of lengths, ``window`` numbers at most, is planned on the
    driver. Pieces are numbered within their length by a range sort of their keys alone, so one common length spreads
    over many tasks, the payload is never a sort key, and it meets its place by ``piece``. The same rows give the same
    sequences where ``order`` tells them apart. ``cut`` is read three times: pass a written table. Where its ids have a
    ``width`` of 2 bytes they leave with 4.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spots = places(counts, window)
    first, seen = {}, 0
    for length in sorted(counts):
        first[length], seen = seen, seen + counts[length]
    keys = numbered(cut.select("length", *order, "piece"), ["length", *order]).select("piece", "length", "row")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("row").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                rank, table = ranks[own] - first[length], spots[length]
                start, n, base, begin = table[np.searchsorted(table[:, 0], rank, side="right") - 1].T
                sequence[own] = base + (rank - start) // n
                offset[own] = begin + (rank - start) % n * length
            yield pa.RecordBatch.from_arrays(
                [batch.column("piece"), pa.array(sequence), pa.array(offset)], ["piece", "sequence_id", "offset"])

    placed = cut.join(keys.mapInArrow(assign, "piece long, sequence_id long, offset long"), "piece")
    return _widened(placed) if width == 2 else placed


def _widened(rows: DataFrame) -> DataFrame:
    """``rows`` whose ids of two bytes are given four."""
    at = rows.columns.index("ids")

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [np.frombuffer(x.as_py(), "<u2").astype("<u4").tobytes() for x in batch.column(at)]
            yield batch.set_column(at, "ids", pa.array(wide, pa.binary()))

    return rows.mapInArrow(widen, rows.schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, length, ids): the pieces of ``packed`` (with ids) put together; at most a window each."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda p: p["ids"])
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.unhex(F.array_join(parts, "")).alias("ids"))


def pack_documents(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, ids: bool = True) -> DataFrame:
    """Pieces of all documents with their sequences; ``ids_crc32`` stands for the ids where ``ids`` is False.

    Ids travel in two bytes where the vocabulary allows, which halves the written pieces and the shuffle.
    """
    width = 2 if max(encoder(path).max_token_value, end_id) < 1 << 16 else 4
    cut = pieces(docs, path, window, end_id, width).select(
        F.monotonically_increasing_id().alias("piece"), "*", F.xxhash64("ids").alias("tie"))
    packed = pack(materialise(cut, "pieces"), window, width, ("doc_id", "start", "doc_tokens", "tie"))
    digest = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", digest, "doc_tokens", *(["ids"] if ids else []), "sequence_id", "offset")
