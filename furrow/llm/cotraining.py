"""Quality classifier by co-training: a content view and a metadata view teach each other."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.toxicity import held_out
from furrow.session import materialise, spread

GRAMS = 512
NAMES = 24
LAYOUT = 12
METADATA = 2 * NAMES + LAYOUT


def content_view(text: bytes) -> np.ndarray:
    """Shares of hashed byte trigrams of the whole text (square roots), and how evenly they are spread."""
    octets = np.frombuffer(text, np.uint8).astype(np.uint32)
    out = np.zeros(GRAMS + 2)
    if len(octets) < 3:
        return out
    code = (octets[:-2] << np.uint32(16)) | (octets[1:-1] << np.uint32(8)) | octets[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - GRAMS.bit_length() + 1)
    share = np.bincount(code, minlength=GRAMS) / len(code)
    out[:GRAMS] = np.sqrt(share)
    out[GRAMS] = np.log(len(code) * (share * share).sum() + 1) - np.log(len(code) / GRAMS + 1)
    out[GRAMS + 1] = share.max()
    return out


_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 sign, 7 above ASCII
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[[9, 32]] = 4
_CLASS[10] = 5
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 6
_CLASS[128:] = 7


def metadata_view(text: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Language, source, length and layout of a page; nothing of what it says."""
    out = np.zeros(METADATA)
    out[xxhash.xxh64_intdigest(f"{lang}") % NAMES] = 1
    out[NAMES + xxhash.xxh64_intdigest(f"{source}") % NAMES] = 1
    counts = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)[:8]
    total = max(1, len(text))
    layout = out[2 * NAMES:]
    layout[:8] = np.sqrt(counts / total)
    layout[8] = np.log1p(n_chars if n_chars is not None else 0) / 10
    layout[9] = np.log1p(counts[5]) / 5
    layout[10] = np.log1p(total / (counts[5] + 1)) / 10
    layout[11] = 1
    return out


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient (first line) and curvature of the weighted logistic loss at ``w``; sums over rows add up."""
    p = _chance(x @ w)
    return np.vstack([x.T @ (weight * (p - y)), (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x])


def _step(w: np.ndarray, sums: np.ndarray, ridge: float) -> np.ndarray:
    """Newton step from the sums, no weight moving more than 5."""
    step = np.linalg.solve(sums[1:] + ridge * np.eye(len(w)), sums[0] + ridge * w)
    return -step * min(1.0, 5 / max(1e-12, np.abs(step).max()))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 25) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last column of ``x`` is constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        step = _step(w, _sums(x, y, weight, w), ridge)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Weights of the two views, their calibrations (slope, offset), and the weights of their sum."""

    content: np.ndarray
    metadata: np.ndarray
    calibrations: tuple[tuple[float, float], tuple[float, float]]
    joint: tuple[float, float, float]

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of the views, and of both together."""
        logits = [np.clip(s * (x @ w) + o, -30, 30) for x, w, (s, o) in
                  zip((content, metadata), (self.content, self.metadata), self.calibrations)]
        both = self.joint[0] * logits[0] + self.joint[1] * logits[1] + self.joint[2]
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (*logits, both))


EDGE = 30
BINS_A_UNIT = 256
BINS = 2 * EDGE * BINS_A_UNIT
RIDGE = 0.05
HANDED_WEIGHT = 0.5


@dataclass(frozen=True)
class Handing:
    """What a round hands over: the views' weights, and the logits below and from which a row is sure."""

    weights: tuple[np.ndarray, ...]
    below: tuple[float, ...]
    above: tuple[float, ...]


Views = list[np.ndarray]
# The sum, over all unlabelled rows, of what a measure finds in a block of them.
Total = Callable[[Callable[[Views], list[np.ndarray]]], list[np.ndarray] | None]


def handed(views: Views, history: Sequence[Handing]) -> list[np.ndarray]:
    """The label each row was given for either view by the other one, the first time that one was sure; NaN if never.

    It follows from the rounds' weights and thresholds alone, so no state of a row is stored between rounds.
    """
    given = [np.full(len(views[0]), np.nan) for _ in views]
    for past in history:
        for own, other in ((0, 1), (1, 0)):
            logit = views[own] @ past.weights[own]
            free = np.isnan(given[other])
            given[other][free & (logit < past.below[own])] = 0.0
            given[other][free & (logit >= past.above[own])] = 1.0
    return given


def _counts(fits: Sequence[np.ndarray]) -> Callable[[Views], list[np.ndarray]]:
    """Measure: how many rows have a logit in each bin, by view."""
    def measure(views: Views) -> list[np.ndarray]:
        found = []
        for x, w in zip(views, fits):
            at = np.floor((x @ w + EDGE) * BINS_A_UNIT).astype(np.int64)
            found.append(np.bincount(np.clip(at, 0, BINS - 1), minlength=BINS)[None].astype(float))
        return found

    return measure


def _taught(history: Sequence[Handing], fits: Sequence[np.ndarray]) -> Callable[[Views], list[np.ndarray]]:
    """Measure: gradient and curvature of the handed rows, by view."""
    def measure(views: Views) -> list[np.ndarray]:
        found = []
        for x, y, w in zip(views, handed(views, history), fits):
            rows = ~np.isnan(y)
            found.append(_sums(x[rows], y[rows], np.full(int(rows.sum()), HANDED_WEIGHT), w))
        return found

    return measure


def _thresholds(counts: np.ndarray, share: float, sure: float) -> tuple[float, float]:
    """Logits that bound the most confident rows: whole bins from either end until ``share`` of the rows is reached."""
    margin = np.log(sure / (1 - sure))
    most = max(1.0, share * counts.sum())
    low = int(np.searchsorted(np.cumsum(counts), most)) + 1
    high = BINS - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), most))
    # An outermost bin also holds what lies beyond it.
    return min(low / BINS_A_UNIT - EDGE, -margin), max(high / BINS_A_UNIT - EDGE, margin)


def exchange(views: Views, label: np.ndarray, total: Total, rounds: int, share: float, sure: float, steps: int) -> Model:
    """Co-training of labelled ``views`` (last column constant, labels 0 and 1) with the rows that ``total`` sums over.

    A fifth of the labelled rows (every fifth) is set apart for the calibrations. In each round a view hands its most
    confident unlabelled rows, about ``share`` of them per class and only beyond ``sure``, to the other view, where
    they count half and keep the label they were given first. Both views then take ``steps`` Newton steps.
    """
    known = np.arange(len(label))
    apart, rows = known[::5], np.setdiff1d(known, known[::5])
    if len({*label[rows].tolist()}) < 2:
        rows = known
    y, ones = label[rows].astype(float), np.ones(len(rows))
    fits = [_fit(x[rows], y, ones, RIDGE) for x in views]
    history: list[Handing] = []
    for _ in range(rounds):
        counts = total(_counts(fits))
        if counts is None:
            break
        bounds = [_thresholds(c[0], share, sure) for c in counts]
        history.append(Handing(tuple(fits), tuple(b for b, _ in bounds), tuple(a for _, a in bounds)))
        for _ in range(steps):
            sums = total(_taught(history, fits))
            fits = [w + _step(w, s + _sums(x[rows], y, ones, w), RIDGE) for w, s, x in zip(fits, sums, views)]
    y, ones = label[apart].astype(float), np.ones(len(apart))
    if len({*y.tolist()}) < 2:
        return Model(fits[0][:-1], fits[1][:-1], ((1.0, float(fits[0][-1])), (1.0, float(fits[1][-1]))), (0.5, 0.5, 0.0))
    calibrations, logits = [], []
    for x, w in zip(views, fits):
        raw = x[apart] @ w
        slope, offset = _fit(np.stack([raw, ones], axis=1), y, ones, ridge=0.5)
        calibrations.append((float(slope), float(offset + slope * w[-1])))
        logits.append(slope * raw + offset)
    joint = _fit(np.stack([*logits, ones], axis=1), y, ones, ridge=0.5)
    return Model(fits[0][:-1], fits[1][:-1], tuple(calibrations), tuple(map(float, joint)))


def _with_constant(*views: np.ndarray) -> Views:
    return [np.hstack([v, np.ones((len(v), 1))]) for v in views]


def co_train(content: np.ndarray, metadata: np.ndarray, label: np.ndarray, rounds: int = 4, share: float = 0.05,
             sure: float = 0.9, steps: int = 3) -> Model:
    """``exchange`` over arrays: rows with label 0 or 1 teach, rows with label -1 are handed over.

    Needs both labels among the rows.
    """
    views = _with_constant(content, metadata)
    pool = [v[label < 0] for v in views]
    return exchange([v[label >= 0] for v in views], label[label >= 0],
                    lambda measure: measure(pool) if len(pool[0]) else None, rounds, share, sure, steps)


AT_ONCE = 2048


def _unpacked(content: pa.Array, metadata: pa.Array) -> Views:
    """Both views of some rows from their binary columns."""
    return _with_constant(*(np.frombuffer(b"".join(c.to_pylist()), np.float32).reshape(len(c), -1).astype(float)
                            for c in (content, metadata)))


def _total(rows: DataFrame) -> Total:
    """Sums over the rows of a written table of views.

    A task adds up its rows, at most a task per core so that a cluster's matrices stay few; the tasks' lines meet by
    line and come to the driver as one matrix per view, whose size does not depend on the table.
    """
    schema = "view int, line int, sums binary"
    few = rows.select("content", "metadata").coalesce(rows.sparkSession.sparkContext.defaultParallelism)

    def lines(found: Iterable[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        view, line, sums = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(view, pa.int32()), pa.array(line, pa.int32()),
                                           pa.array([s.tobytes() for s in sums], pa.binary())], ["view", "line", "sums"])

    def total(measure: Callable[[Views], list[np.ndarray]]) -> list[np.ndarray] | None:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: list[np.ndarray] | None = None
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    found = measure(_unpacked(*batch.slice(at, AT_ONCE).columns))
                    sums = found if sums is None else [a + b for a, b in zip(sums, found)]
            if sums is not None:
                yield lines((v, k, line) for v, matrix in enumerate(sums) for k, line in enumerate(matrix))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for view, line, values in zip(*(c.to_pylist() for c in batch.columns)):
                    sums[view, line] = sums.get((view, line), 0.0) + np.frombuffer(values)
            if sums:
                yield lines((*key, values) for key, values in sums.items())

        found = few.mapInArrow(scan, schema).repartition("view", "line").mapInArrow(add, schema).toArrow().to_pylist()
        if not found:
            return None
        return [np.stack([np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["line"]) if r["view"] == view])
                for view in (0, 1)]

    return total


def _views(rows: DataFrame) -> DataFrame:
    """``rows`` (text, lang, source, n_chars, doc_id, label) as (doc_id, label, content, metadata), the views as binary floats."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_both(*values) for values in zip(*(batch.column(k).to_pylist() for k in range(4)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(4), batch.column(5), *(pa.array([v[k].astype(np.float32).tobytes() for v in found], pa.binary())
                                                     for k in (0, 1))], ["doc_id", "label", "content", "metadata"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, label int, content binary, metadata binary")


def _both(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    data = (text or "").encode()
    return content_view(data), metadata_view(data, lang, source, n_chars)


COLUMNS = ("text", "lang", "source", "n_chars")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 5_000, rounds: int = 4,
          share: float = 0.05, sure: float = 0.9, steps: int = 3) -> Model | None:
    """Co-trained model from at most ``max_labelled`` labelled documents (by hash of doc_id) and all other documents.

    Labels of held-out rows (crc32 of the doc_id modulo 3 is 1) are not learned from; of several labels of a doc_id
    the smallest counts, of several rows of a labelled doc_id one teaches. Every other row of ``docs`` is unlabelled,
    whatever its number: the views of all rows are written once, and each round reads them to find what is sure (by
    counts of logits) and to add up gradients and curvatures. Only the labelled sample and matrices of fixed size come
    to the driver. None if one of the classes has no row.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    order = (F.xxhash64("doc_id"), "doc_id")
    taught = known.filter(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1)).orderBy(*order).limit(max_labelled)
    marked = spread(docs.select("doc_id", *COLUMNS)).join(F.broadcast(taught), "doc_id", "left")
    rows = materialise(_views(marked.select(*COLUMNS, "doc_id", F.coalesce("label", F.lit(-1)).alias("label"))), "views")
    one = F.min(F.struct("content", "metadata", "label")).alias("one")
    sample = rows.filter("label >= 0").groupBy("doc_id").agg(one).orderBy(*order).select("one.*").toArrow()
    mark = sample.column("label").to_numpy()
    if not ((mark == 0).any() and (mark == 1).any()):
        return None
    views = _unpacked(sample.column("content"), sample.column("metadata"))
    return exchange(views, mark, _total(rows.filter("label < 0")), rounds, share, sure, steps)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, content_score, metadata_score, score), one per row of ``docs``; scores are 0.5 without a model.

    Nulls: a null text is empty, a null language or source is a value of its own, a null n_chars is zero.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not batch.num_rows:
                columns = [np.full(batch.num_rows, 0.5)] * 3
            else:
                found = [_both(*values) for values in zip(*(batch.column(c).to_pylist() for c in COLUMNS))]
                columns = model.scores(np.array([c for c, _ in found]), np.array([m for _, m in found]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)],
                                             ["doc_id", "content_score", "metadata_score", "score"])

    rows = spread(docs.select("doc_id", *COLUMNS))
    return rows.mapInArrow(scan, f"doc_id {kind}, content_score double, metadata_score double, score double")
