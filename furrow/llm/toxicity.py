"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import spread

# Digits and signs read as letters, and letters of other scripts that look like Latin ones.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "ł": "l", "đ": "d",
}
# Innocent phrases around words that are often insults.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pathetic fallacy")
WORD = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in (DIGITS | LOOKALIKES).items()}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if base.isascii() and base.isalnum() and code not in table:
            table[code] = DIGITS.get(base, base)
    for code in (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF):
        table[code] = ""  # combining marks and characters without width
    return table


_FOLD = _fold_table()


def fold(text: str) -> str:
    """Lower case with accents off, look-alike letters and digits read as Latin letters, invisible characters gone."""
    text = text.lower().translate(_FOLD)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: SIGNS[m.group()], text)
    return text


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Lexicon:
    """Terms with weights; a term matches at the start of a word, one that ends in a space only a whole word."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: intercept, log(1 + weight of the hits), log(1 + words), that weight per 100 words, as a logistic model
    model: tuple[float, ...] = (-6.0, 3.0, -0.2, 0.0)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "model": self.model, "_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                word = term.rstrip(" ")
                whole, old = term.endswith(" "), self._machine.get(word, None)
                spec = (len(word), None if whole else weight, weight if whole else None, False)
                if old:
                    spec = (len(word), old[1] if spec[1] is None else spec[1], old[2] if spec[2] is None else spec[2], False)
                self._machine.add_word(word, spec)
            for phrase in self.exceptions:
                folded = fold(phrase)
                if folded not in self._machine:
                    self._machine.add_word(folded, (len(folded), None, None, True))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def measure(self, text: str) -> tuple[float, int, int]:
        """Weight of the hits, their number, and the number of words of a whole text."""
        folded = fold(text)
        machine, hits, spared = self.machine(), {}, []
        if len(machine):
            for end, (size, start_weight, whole_weight, exception) in machine.iter(folded):
                begin, after = end - size + 1, end + 1
                if begin and folded[begin - 1].isalnum():
                    continue
                closed = after == len(folded) or not folded[after].isalnum()
                if exception:
                    if closed:
                        spared.append((begin, after))
                    continue
                weight = max(start_weight or 0.0, whole_weight or 0.0 if closed else 0.0)
                if weight:
                    hits[begin] = max(weight, hits.get(begin, 0.0))
        weights = [w for b, w in hits.items() if not any(s <= b < e for s, e in spared)] if spared else list(hits.values())
        return sum(weights), len(weights), len(text.split())

    def features(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Columns of the logistic model."""
        return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(words), 100 * weight / np.maximum(words, 20)], axis=1)

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(weight, words) @ np.array(self.model), -30, 30)))


def _labelled(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int) -> DataFrame:
    """Texts of at most ``max_labelled`` labelled rows outside the held-out third, by hash of the doc_id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label")


def _terms_of(text: str, shortest: int = 3, longest: int = 7) -> set[str]:
    """Words of a folded text (with a space behind) and their beginnings."""
    words = set(WORD.findall(fold(text)))
    return {w + " " for w in words if shortest <= len(w) <= 24} | {
        w[:n] for w in words for n in range(shortest, min(longest, len(w)) + 1)}


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int, max_terms: int) -> dict[str, float]:
    """Weights of the terms kept from counts (term, toxic documents, clean documents).

    Weight: smoothed log ratio of the document shares; at least 3 (twenty times as common in toxic documents). A
    beginning gives way to a longer term that covers 95 % of it; a term gives way to a kept beginning of itself.
    """
    weight = {t: float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))) for t, a, b in rows}
    count = {t: a for t, a, _ in rows if weight[t] >= 3}
    covered: dict[str, int] = {}
    for term, n in count.items():
        for size in range(3, len(term.rstrip(" ")) + (term[-1] == " ")):
            covered[term[:size]] = max(n, covered.get(term[:size], 0))
    kept: dict[str, float] = {}
    for term in sorted(count, key=lambda t: (len(t), t)):
        if covered.get(term, 0) >= 0.95 * count[term]:
            continue
        if not any(term[:size] in kept for size in range(3, len(term))):
            kept[term] = weight[term]
    best = sorted(kept, key=lambda t: (-kept[t], t))[:max_terms]
    return {t: round(kept[t], 6) for t in best}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = 20_000, max_terms: int = 2_000,
          exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon and score model from labelled texts.

    At most ``max_labelled`` labelled rows are learned from, none of them held out; of several labels of one doc_id
    the largest counts. The lexicon has at most ``max_terms`` terms, so it and the counts brought to the driver are
    bounded. Without toxic or without clean rows there is nothing to learn: the lexicon is empty and all scores are low.
    """
    sample = _labelled(docs, labels, label, max_labelled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        total = [0, 0]
        for batch in batches:
            for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[mark] += 1
                seen[mark].update(_terms_of(text))
        terms = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_pydict({
            "term": [" ", *terms], "a": [total[1], *(seen[1][t] for t in terms)], "b": [total[0], *(seen[0][t] for t in terms)]})

    marks = sample.select("text", (F.col("label") > 0).cast("int").alias("label"))
    counts = marks.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = counts.filter((F.col("a") >= 4) & (F.col("a") > F.col("b")) | (F.col("term") == " "))
    rows = counts.orderBy(F.col("term") != " ", F.desc("a"), "term").limit(10 * max_terms).collect()
    toxic, clean = next(((r["a"], r["b"]) for r in rows if r["term"] == " "), (0, 0))
    if not toxic or not clean:
        return Lexicon({}, exceptions)
    least = max(4, toxic // 200)
    terms = choose_terms([(r["term"], r["a"], r["b"]) for r in rows if r["term"] != " " and r["a"] >= least],
                         toxic, clean, max_terms)
    lexicon = Lexicon(terms, exceptions)
    measured = _measure(marks, lexicon).select("weight", "words", "label").toArrow()
    weight, words, y = (measured.column(c).to_numpy() for c in ("weight", "words", "label"))
    lexicon.model = tuple(float(v) for v in _logistic(lexicon.features(weight, words), y.astype(float)))
    return lexicon


def _measure(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` with the text replaced by (weight, hits, words, score)."""
    others = [f for f in rows.schema.fields if f.name != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.measure(t.as_py() or "") for t in batch.column("text")]
            weight, hits, words = (np.array([f[i] for f in found], float) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in others), pa.array(weight), pa.array(hits.astype(np.int64)),
                 pa.array(words.astype(np.int64)), pa.array(lexicon.score(weight, words))],
                [*(f.name for f in others), "weight", "hits", "words", "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return rows.mapInArrow(scan, f"{fields}weight double, hits long, words long, score double")


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows (doc_id, weight, hits, words, score): toxicity of every whole text; null and empty texts have no hit.

    One row per input row, ties and repeated rows included; no column but the text enters the score.
    """
    return _measure(spread(docs.select("doc_id", "text")), lexicon)


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is below ``threshold``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.measure(t.as_py() or "") for t in batch.column("text")]
            score = lexicon.score(np.array([f[0] for f in found], float), np.array([f[2] for f in found], float))
            yield batch.filter(pa.array(score < threshold))

    return spread(docs).mapInArrow(scan, fields)
