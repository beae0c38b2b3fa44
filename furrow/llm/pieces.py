"""Sampled segmentation into the pieces of a SentencePiece file, and lossless decoding.

Forward filtering, backward sampling: a forward pass sums the weights of all segmentations up to each position of the
piece lattice, and a backward pass draws one piece after the other from the exact posterior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import spread

DENSE = 128  # the commonest characters have a column of their own in the trie's table
_SEGMENT = re.compile(" +[^ ]*")


def _mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each input (splitmix finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces of a file, their weights and their trie.

    A file of the byte-pair kind holds ranks, not probabilities; the weight of the piece of rank r is taken as
    1 / (r + 10), scaled to sum to one, to the power ``alpha`` (larger: closer to the best segmentation). A character
    without a piece of its own is spelled in byte pieces.
    """

    def __init__(self, path: str, alpha: float = 1.0):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal = [(i, p.piece.replace("▁", " ")) for i, p in enumerate(model.pieces) if p.type == 1]
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.bytes = [b""] * len(model.pieces)
        self.octets = np.array([self.byte_ids[b] for b in range(256)], np.int64)
        for i, piece in normal:
            self.bytes[i] = piece.encode()
        for value, i in self.byte_ids.items():
            self.bytes[i] = bytes([value])
        share = 1 / (np.arange(len(normal)) + 10.0)
        logs = alpha * np.log(share / share.sum())
        self.byte_weight = float(logs[-1])
        self._grow([(i, piece, w) for (i, piece), w in zip(normal, logs.tolist())])

    def _grow(self, pieces: list[tuple[int, str, float]]) -> None:
        often: dict[str, int] = {}
        for _, piece, _ in pieces:
            for c in piece:
                often[c] = often.get(c, 0) + 1
        self.kinds = np.zeros(0x110000, np.int32)  # 0: in no piece
        for k, c in enumerate(sorted(often, key=lambda c: (-often[c], c))):
            self.kinds[ord(c)] = k + 1
        children: list[dict[int, int]] = [{}]
        ids, weights = [-1], [0.0]
        for i, piece, weight in pieces:
            node = 0
            for c in piece:
                kind = int(self.kinds[ord(c)])
                if kind not in children[node]:
                    children[node][kind] = len(children)
                    children.append({})
                    ids.append(-1)
                    weights.append(0.0)
                node = children[node][kind]
            ids[node], weights[node] = i, weight
        self.ids, self.weights = np.array(ids, np.int32), np.array(weights)
        self.dense = np.zeros((len(children), DENSE), np.int32)
        rare = []
        for node, below in enumerate(children):
            for kind, child in below.items():
                if kind < DENSE:
                    self.dense[node, kind] = child
                else:
                    rare.append((node << 20 | kind, child))
        rare.sort()
        self.rare = np.array([k for k, _ in rare] + [1 << 62], np.int64)
        self.rare_child = np.array([c for _, c in rare] + [0], np.int32)

    def step(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Child of each node by a character; 0 where there is none."""
        out = self.dense[node, np.where(kind < DENSE, kind, 0)]
        far = np.flatnonzero(kind >= DENSE)
        if len(far):
            code = node[far].astype(np.int64) << 20 | kind[far]
            at = np.searchsorted(self.rare, code)
            out[far] = np.where(self.rare[at] == code, self.rare_child[at], 0)
        return out

    def decode(self, ids) -> str:
        """The text of a segmentation, byte for byte; the blank put before the text is taken off."""
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]


class Lattice:
    """Piece lattices of many segments at once. Boundaries are numbered through; edges are grouped by their end."""

    def __init__(self, vocabulary: Vocabulary, segments: list[str]):
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        text = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(segments)), sizes)
        base = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(segments) else np.zeros(0, np.int64)
        self.text = text
        self.first = base + np.arange(len(segments))
        self.last = self.first + sizes
        left = sizes[owner] - (np.arange(len(text)) - base[owner])  # characters up to the segment's end
        kinds = vocabulary.kinds[text]
        at, node = np.arange(len(text)), np.zeros(len(text), np.int32)
        starts, lengths, ids, weights = [], [], [], []
        single = np.zeros(len(text), bool)
        length = 0
        while len(at):
            node = vocabulary.step(node, kinds[at + length])
            length += 1
            alive = node > 0
            at, node = at[alive], node[alive]
            hit = vocabulary.ids[node] >= 0
            starts.append(at[hit])
            lengths.append(np.full(int(hit.sum()), length))
            ids.append(vocabulary.ids[node[hit]].astype(np.int64))
            weights.append(vocabulary.weights[node[hit]])
            if length == 1:
                single[at[hit]] = True
            more = left[at] > length
            at, node = at[more], node[more]
        spelled = np.flatnonzero(~single)
        width = 1 + (text[spelled] > 0x7F) + (text[spelled] > 0x7FF) + (text[spelled] > 0xFFFF)
        starts.append(spelled)
        lengths.append(np.ones(len(spelled), np.int64))
        # one byte: its piece; more: below zero, the character to spell
        ids.append(np.where(width == 1, vocabulary.octets[np.minimum(text[spelled], 255)], -1 - text[spelled]))
        weights.append(width * vocabulary.byte_weight)
        # grouped by end, longest first; ends in the order of their distance from the segment's start
        start, length = np.concatenate(starts[::-1]), np.concatenate(lengths[::-1])
        within = start - base[owner[start]] + length if len(start) else start
        source = start + owner[start] if len(start) else start
        target = source + length
        order = np.argsort(within * (len(text) + len(segments) + 1) + target, kind="stable")
        self.source, self.ids = source[order], np.concatenate(ids[::-1])[order]
        weight, target, within = np.concatenate(weights[::-1])[order], target[order], within[order]
        heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.zeros(0, np.int64)
        # forward filtering: positions at the same distance from their segment's start go together
        self.alpha = np.zeros(len(text) + len(segments))
        cuts = np.searchsorted(within[heads], np.arange(1, (sizes.max() if len(sizes) else 0) + 2))
        bounds = np.append(heads, len(target))
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if begin < end:
                lo, hi = bounds[begin], bounds[end]
                paths = self.alpha[self.source[lo:hi]] + weight[lo:hi]
                self.alpha[target[heads[begin:end]]] = np.logaddexp.reduceat(paths, heads[begin:end] - lo)
        share = np.exp(self.alpha[self.source] + weight - self.alpha[target])
        total = np.cumsum(share)
        before = total[heads] - share[heads]
        self.cumulative = total - np.repeat(before, np.diff(bounds))
        self.head = np.zeros(len(self.alpha), np.int64)
        self.tail = np.zeros(len(self.alpha), np.int64)
        self.head[target[heads]], self.tail[target[heads]] = heads, bounds[1:] - 1

    def sample(self, segment: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling for occurrences of segments, each with its own 64-bit key.

        Returns the piece ids of all occurrences one after the other, and the number of pieces of each.
        """
        where = self.last[segment].copy()
        goal, alive = self.first[segment], np.arange(len(segment))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(alive):
            at = where[alive]
            draw = _mix(key[alive] + np.uint64(len(steps) * 0xD1342543DE82EF95 & (1 << 64) - 1))
            draw = (draw >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            edge, end = self.head[at], self.tail[at]
            open_ = np.flatnonzero((draw > self.cumulative[edge]) & (edge < end))
            while len(open_):
                edge[open_] += 1
                open_ = open_[(draw[open_] > self.cumulative[edge[open_]]) & (edge[open_] < end[open_])]
            steps.append((alive, self.ids[edge]))
            where[alive] = self.source[edge]
            alive = alive[where[alive] > goal[alive]]
        counts = np.zeros(len(segment), np.int64)
        for owner, _ in steps:
            counts[owner] += 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (owner, ids) in enumerate(steps):
            out[ends[owner] - 1 - k] = ids
        return out, counts


@cache
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def segment_texts(vocab: Vocabulary, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
    """Sampled piece ids of each text. ``keys``: a 64-bit number per text, which alone decides its draws."""
    known: dict[str, int] = {}
    parts, sizes = [], []
    for text in texts:
        found = [known.setdefault(s, len(known)) for s in _SEGMENT.findall(" " + text)] if text else []
        parts.extend(found)
        sizes.append(len(found))
    lattice = Lattice(vocab, list(known))
    counts = np.array(sizes, np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    ids, pieces = lattice.sample(np.array(parts, np.int64), _mix(keys[owner] + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    ends = np.cumsum(pieces)
    ends = np.concatenate(([0], ends))[np.cumsum(counts)]
    out = []
    for begin, end in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()):
        own = ids[begin:end]
        if len(own) and own.min() < 0:
            spelled: list[int] = []
            for i in own.tolist():
                spelled.extend([vocab.byte_ids[b] for b in chr(-1 - i).encode()] if i < 0 else [i])
            own = np.array(spelled, np.int64)
        out.append(own)
    return out


def row_keys(doc_ids: list, seed: int) -> np.ndarray:
    """A 64-bit key for each doc_id and the seed; a null doc_id has the key of the seed."""
    ids = np.array([0 if d is None else (int(d) + 1) % (1 << 64) for d in doc_ids], np.uint64)
    return _mix(_mix(ids) ^ np.uint64(seed))


def encode(docs: DataFrame, path: str, alpha: float = 0.5, seed: int = 42, block: int = 2_000_000) -> DataFrame:
    """Rows (doc_id, ids, lossless): a sampled segmentation of every whole text.

    ``ids`` holds little-endian unsigned 32-bit integers. A blank is put before a text that is not empty, as the
    file's own encoder does; a null or empty text has no pieces. The draws depend on doc_id, seed and text alone, so
    any partitioning, and any second run, gives the same ids; repeated rows get equal ids. ``lossless`` tells that
    decoding gave back the text. Texts are worked on in blocks of about ``block`` characters, which bounds the lattice
    held at once by a block and the longest text.
    """
    rows = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, alpha)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            begin, size = 0, 0
            for at in range(len(ids)):
                size += len(texts[at].as_py())
                if size >= block or at + 1 == len(ids):
                    own = texts.slice(begin, at + 1 - begin).to_pylist()
                    found = segment_texts(vocab, own, row_keys(ids[begin:at + 1], seed))
                    same = [vocab.decode(f.tolist()) == t for f, t in zip(found, own)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, at + 1 - begin),
                         pa.array([f.astype("<u4").tobytes() for f in found], pa.binary()), pa.array(same)],
                        ["doc_id", "ids", "lossless"])
                    begin, size = at + 1, 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, ids binary, lossless boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, text) from rows with doc_id and ids, as :func:`encode` gives them; null ids give a null text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, 1.0)
        for batch in batches:
            found = [None if v.as_py() is None else vocab.decode(np.frombuffer(v.as_py(), "<u4").tolist()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(scan, f"doc_id {kind}, text string")
