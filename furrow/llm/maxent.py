"""Language-model scores of documents by a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.wordchunks import MARK, chunks, local_ids, packed, unpacked
from furrow.session import materialise

END, TAIL = 0, 1  # outputs of the model before the frequent words
FEATURES = 3  # the word before, the two words before, the word before that (skip)
CHUNK = 1 << 18  # words of a chunk
BATCH = 8  # chunks that go to a Python worker at once while the model is fitted
BLOCK = 1 << 14  # tokens of one numpy step
ROWS = 256  # rows of a weight table that travel together


@dataclass(frozen=True)
class Training:
    """``share``: a word of at least one in ``share`` tokens has an output of its own, so there are ``share`` at most.

    ``buckets`` rows of hashed features per factor; ``rounds`` updates, each over one of ``slices`` parts of the texts
    in turn; ``step`` is the length of an update and ``prior`` the count that holds a weight back.
    """

    share: int = 16_384
    buckets: int = 1 << 14  # 65,536 at most
    rounds: int = 6
    slices: int = 6
    step: float = 0.8
    prior: float = 4.0


@dataclass
class Model:
    """Weights of both factors: a class of the next word, and a word in its class; sizes hang on ``Training`` alone.

    ``place`` holds class and slot of every output; class 0 is that of the rare words alone.
    """

    place: np.ndarray
    bias: tuple[np.ndarray, np.ndarray]
    weights: tuple[np.ndarray, np.ndarray]


def lm_words(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only) and the end, as :data:`MARK`."""
    return [*text.lower().split(), MARK]


def start(totals: np.ndarray, buckets: int) -> Model:
    """The unigram model of outputs that occur ``totals`` times; feature weights are zero."""
    others = np.delete(np.arange(len(totals)), TAIL)
    slots = int(np.ceil(np.sqrt(len(others))))
    classes = 1 + -(-len(others) // slots)
    place = np.zeros((2, len(totals)), np.int64)
    place[:, others] = 1 + np.arange(len(others)) // slots, np.arange(len(others)) % slots
    mass = np.zeros((classes, slots))
    mass[place[0], place[1]] = totals + 0.5
    with np.errstate(divide="ignore"):
        within = np.maximum(np.log(mass), -1e4)
    bias = np.log(mass.sum(axis=1))[None, :].astype(np.float32), within.astype(np.float32)
    return Model(place, bias, (np.zeros((buckets, classes), np.float32), np.zeros((buckets, slots), np.float32)))


def histories(ids: np.ndarray, ends: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The output before each token and the one before that; a text begins after ``pad``."""
    first = np.concatenate(([0], ends[:-1])).astype(np.int64)
    one, two = np.empty(len(ids), np.int32), np.empty(len(ids), np.int32)
    one[1:], two[1:] = ids[:-1], one[:-1]
    one[first] = pad
    two[1:] = one[:-1]
    two[first] = pad
    return one, two


def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A 64-bit number for each feature of the histories."""
    one, two = one.astype(np.uint64), two.astype(np.uint64)
    return _mix(np.stack((one, one + (two + np.uint64(1)) * np.uint64(1 << 20), two + np.uint64(1 << 50))))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def factors(model: Model, keys: np.ndarray, outputs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per factor: (its number, the tokens it speaks of, hashed rows, right column, probabilities of all columns).

    The class of the rare words holds one output, so the second factor leaves its tokens out.
    """
    own, slot = model.place[:, outputs]
    buckets = np.uint64(len(model.weights[0]))
    for factor, bias in enumerate(model.bias):
        some, column = np.arange(len(outputs)), own
        if factor:
            some = np.flatnonzero(own)
            keys, own, column = keys[:, some], own[some], slot[some]
            with np.errstate(over="ignore"):
                keys = _mix(keys + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rows, table = (keys % buckets).astype(np.uint16), model.weights[factor]
        logits = bias[own] if factor else np.repeat(bias, len(some), axis=0)
        for row in rows:
            logits += np.take(table, row, axis=0, mode="clip")
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        yield factor, some, rows, column, logits


class Moments:
    """Observed and expected use of every weight, as the gradient of the log probability needs them."""

    def __init__(self, model: Model):
        self.seen = [np.zeros(w.shape) for w in model.weights]
        self.expected = [np.zeros(w.shape) for w in model.weights]

    def add(self, model: Model, keys: np.ndarray, outputs: np.ndarray) -> None:
        for factor, _, rows, column, p in factors(model, keys, outputs):
            shape = self.seen[factor].shape
            block, columns = np.zeros(shape[0] * shape[1], np.float32), np.arange(shape[1])
            p = p.reshape(-1).view(np.float32)  # a dtype that was pickled is another object, which add.at takes 20 times slower
            for row in rows:
                first = row.astype(np.int64) * shape[1]
                self.seen[factor] += np.bincount(first + column, minlength=len(block)).reshape(shape)
                np.add.at(block, (first[:, None] + columns).reshape(-1), p)
            self.expected[factor] += block.reshape(shape)


def updated(model: Model, seen: list[np.ndarray], expected: list[np.ndarray], training: Training) -> Model:
    """One step along the gradient, seen minus expected, each weight scaled by a bound of its curvature."""
    weights = tuple(
        (w + training.step * (s - e) / (np.maximum(s, e) + training.prior)).astype(np.float32)
        for w, s, e in zip(model.weights, seen, expected))
    return Model(model.place, model.bias, weights)


def log_probabilities(model: Model, ids: np.ndarray, ends: np.ndarray, pad: int) -> np.ndarray:
    """log10 of the model's probability of every output, given what stands before it in its text."""
    (one, two), out = histories(ids, ends, pad), np.empty(len(ids))
    for at in range(0, len(ids), BLOCK):
        part = slice(at, at + BLOCK)
        total = np.zeros(len(ids[part]))
        for _, some, _, column, p in factors(model, features(one[part], two[part]), ids[part]):
            total[some] += np.log10(np.maximum(p[np.arange(len(column)), column], 1e-38))
        out[part] = total
    return out


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; one without a number is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


@dataclass
class Vocabulary:
    """Counts of the training tokens: their number, the different ones, the texts, and the frequent words with theirs."""

    tokens: int
    types: int
    texts: int
    frequent: dict[str, int]

    @property
    def totals(self) -> np.ndarray:
        rest = self.tokens - self.texts - sum(self.frequent.values())
        return np.array([self.texts, rest, *self.frequent.values()], float)

    @property
    def rare_types(self) -> int:
        return self.types - (self.texts > 0) - len(self.frequent)


def read(docs: DataFrame, training: Training) -> tuple[DataFrame, Vocabulary]:
    """Texts as output numbers in chunks, written, with the unigram sums of each text, and the vocabulary.

    Rows (chunk, ids, ends, doc_ids, turn, base, known, tail): per text ``turn`` is a number that deals it to a round, -1
    where it is held out, ``base`` its unigram score, ``known`` the tokens that training has seen, ``tail`` the score of
    its rare words among all rare words.
    """
    chunked = materialise(chunks(docs, lm_words, F.lit(""), ~held_out(F.col("doc_id")), CHUNK), "lm-chunks")
    sums = chunked.agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"), F.sum("marks").alias("m")).first()
    texts, tokens = sums["m"] or 0, (sums["n"] or 0) + (sums["m"] or 0)
    # a word is one row per chunk, so none is hot; one shuffle counts it and tells all its chunks
    same = Window.partitionBy("word")
    words = chunked.select("chunk", F.posexplode(F.arrays_zip("words", "n")).alias("at", "w"))
    words = words.select("chunk", (F.col("at") + 1).alias("at"), F.col("w.words").alias("word"), F.col("w.n").alias("n"))
    words = words.withColumns({"f": F.sum("n").over(same), "one": F.min(F.when(F.col("n") > 0, F.col("chunk"))).over(same)})
    often = F.col("f") * training.share >= tokens
    words = materialise(words.select(
        "chunk", "at", "f", F.when(often & (F.col("f") > 0), F.col("word")).alias("word"),
        F.coalesce(F.col("one") == F.col("chunk"), F.lit(False)).alias("one")), "lm-words")
    types = words.agg(F.count_if("one")).first()[0]
    frequent = words.filter("one AND word IS NOT NULL").select("word", "f").collect()
    frequent.sort(key=lambda r: (-r["f"], r["word"]))
    vocabulary = Vocabulary(tokens, types + (texts > 0), texts, {r["word"]: r["f"] for r in frequent})
    numbers = docs.sparkSession.createDataFrame(
        [(w, k + TAIL + 1) for k, w in enumerate(vocabulary.frequent)], "word string, id long")
    # one number a word, so that a chunk's list stays small: a rare word with its count, a frequent one (negative) with its id
    code = F.coalesce(-F.shiftleft("id", 28) - F.col("at"), F.shiftleft("f", 28) + F.col("at"))
    known = words.join(F.broadcast(numbers), "word", "left").groupBy("chunk").agg(F.collect_list(code).alias("known"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    outputs = vocabulary.totals.astype(np.int64)
    whole = np.log10(tokens + 0.5 * (vocabulary.types + 1))
    rare = np.log10(vocabulary.totals[TAIL] + 0.5 * (vocabulary.rare_types + 1))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                local, ends = local_ids(batch, row), batch.column("ends")[row].values.to_numpy()
                codes = batch.column("known")[row].values
                codes = np.zeros(0, np.int64) if codes is None else codes.to_numpy()
                at, value = np.abs(codes) & (1 << 28) - 1, np.abs(codes) >> 28
                f, ids = np.zeros(len(codes) + 1, np.int64), np.full(len(codes) + 1, TAIL)
                f[at] = np.where(codes < 0, outputs[np.where(codes < 0, value, 0)], value)
                ids[at[codes < 0]] = value[codes < 0]
                f[0], ids[0] = texts, END
                f, ids = f[local], ids[local]
                begin = np.concatenate(([0], ends[:-1])).astype(np.int64)
                score = np.log10(f + 0.5)
                sums = [np.add.reduceat(score - whole, begin), np.add.reduceat((f > 0).astype(np.int64), begin),
                        np.add.reduceat(np.where(ids == TAIL, score - rare, 0.0), begin)]
                turn = [zlib.crc32(str(d).encode()) // 5 if c else -1 for d, c in zip(
                    batch.column("doc_ids")[row].as_py(), batch.column("counted")[row].as_py())]
                one, sums = batch.slice(row, 1), [np.array(turn, np.int64), *sums]
                listed = [pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(s)) for s in sums]
                yield pa.RecordBatch.from_arrays(
                    [one.column("chunk"), pa.array([packed(ids, 2)], pa.binary()), one.column("ends"),
                     one.column("doc_ids"), *listed],
                    ["chunk", "ids", "ends", "doc_ids", "turn", "base", "known", "tail"])

    rows = chunked.drop("words", "n").join(known, "chunk", "left").mapInArrow(
        number, f"chunk long, ids binary, ends array<long>, doc_ids array<{kind}>, turn array<long>, "
                "base array<double>, known array<long>, tail array<double>")
    return materialise(rows, "lm-texts"), vocabulary


def _unpack(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    ends = batch.column("ends")[row].values.to_numpy()
    return unpacked(batch.column("ids")[row].as_py(), 2, int(ends[-1])).astype(np.int32), ends


def gradient(texts: DataFrame, model: Model, pad: int, part: int, slices: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Observed and expected use of all weights over one part of the texts that are learned from.

    A task adds its texts up and sends blocks of :data:`ROWS` rows of the four tables, which are summed by block; a
    cluster runs no more tasks here than it has cores. What reaches the driver has the size of the model.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, any_ = Moments(model), False
        for batch in batches:
            for row in range(batch.num_rows):
                ids, ends = _unpack(batch, row)
                turn = batch.column("turn")[row].values.to_numpy()
                some = np.flatnonzero(np.repeat((turn >= 0) & (turn % slices == part), np.diff(ends, prepend=0)))
                one, two = histories(ids, ends, pad)
                for at in range(0, len(some), BLOCK):
                    any_, part_ = True, some[at:at + BLOCK]
                    moments.add(model, features(one[part_], two[part_]), ids[part_])
        if not any_:
            return
        for table, values in enumerate([*moments.seen, *moments.expected]):
            for at in range(0, len(values), ROWS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([table], pa.int32()), pa.array([at], pa.int32()),
                     pa.array([values[at:at + ROWS].astype("<f4").tobytes()], pa.binary())], ["table", "at", "data"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d.as_py(), "<f4").astype(float) for d in group.column("data"))
        return pa.table({"table": group.column("table")[:1], "at": group.column("at")[:1],
                         "data": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    cores = texts.sparkSession.sparkContext.defaultParallelism
    form = "table int, at int, data binary"
    parts = texts.select("ids", "ends", "turn").coalesce(cores).mapInArrow(scan, form)
    sums = Moments(model)
    tables = [*sums.seen, *sums.expected]
    for row in parts.groupBy("table", "at").applyInArrow(add, form).toArrow().to_pylist():
        table = tables[row["table"]]
        table[row["at"]:row["at"] + ROWS] = np.frombuffer(row["data"], "<f8").reshape(-1, table.shape[1])
    return sums.seen, sums.expected


def fit(texts: DataFrame, vocabulary: Vocabulary, training: Training = Training()) -> Model:
    """The model after ``rounds`` updates, each by the gradient over all texts of its part."""
    totals = vocabulary.totals
    model = start(totals, training.buckets)
    conf, name = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, BATCH)  # a row is a whole chunk
    try:
        for number in range(training.rounds):
            model = updated(model, *gradient(texts, model, len(totals), number % training.slices, training.slices), training)
    finally:
        conf.set(name, before)
    return model


def score(docs: DataFrame, training: Training = Training()) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Tokens are words in lower case and an end. ``base_score`` sums the smoothed log10 probabilities of single tokens,
    ``score`` those of the model given the two tokens before. A word outside the frequent ones is one output of the
    model, divided among the rare words, and one more for all unseen ones, by their counts. A null text is empty and
    has its end alone; a null doc_id is learned from; repeated rows are texts of their own; an empty table gives no
    rows; where nothing may be learned, scores rest on the smoothing. Other columns are not read.
    """
    texts, vocabulary = read(docs, training)
    model, pad = fit(texts, vocabulary, training), len(vocabulary.totals)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, ends = _unpack(batch, row)
                begin = np.concatenate(([0], ends[:-1])).astype(np.int64)
                sums = np.add.reduceat(log_probabilities(model, ids, ends, pad), begin)
                base, known, tail, turn = (batch.column(c)[row].values for c in ("base", "known", "tail", "turn"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(turn.to_numpy() < 0),
                     pa.array(np.diff(ends, prepend=0)), known, base, pa.array(sums + tail.to_numpy())],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = texts.mapInArrow(scan, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
                         "base_score", "score")
