from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import periodic
from furrow.llm.queries import QUERIES

from .conftest import frame


def brute(words, least=24, times=3):
    """Runs by comparing all words p apart, for every p."""
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            part = words[start:start + length]
            if length >= max(least, times * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((start, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    return " ".join(w for k, w in enumerate(words) if not any(s + p <= k < s + n for s, n, p in runs))


def text(rng, n, letters):
    """Random words of which stretches repeat with all kinds of periods."""
    out = []
    while len(out) < n:
        part = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 9, 31, 40, 62]))]
        out += (part * rng.choice([1, 1, 2, 3, 4, 9]))[:rng.randint(1, 300)]
        if rng.random() < 0.3:
            out = out[:-1]
    return out[:n]


def test_cover():
    differences = {(a - b) % periodic.MODULUS for a in periodic.COVER for b in periodic.COVER}
    assert differences == set(range(periodic.MODULUS)) and periodic.SHIFT.max() < periodic.MODULUS


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_extensions(letters):
    rng = np.random.default_rng(letters)
    words = np.concatenate((rng.integers(0, letters, 700), [9], np.tile(rng.integers(0, letters, 37), 30), [10]))
    extend = periodic.Extensions(words)
    i, j = rng.integers(0, len(words), 3000), rng.integers(0, len(words), 3000)
    i, j = i[i != j], j[i != j]

    def plain(a, b):
        k = 0
        while max(a, b) + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        return k

    assert extend(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist())]


@pytest.mark.parametrize("letters, least, times", [("a", 24, 3), ("ab", 24, 3), ("ab", 4, 2), ("abcdefgh", 24, 3), ("abc", 7, 2)])
def test_runs_of_many_texts(letters, least, times):
    rng = random.Random(len(letters) + least)
    texts = [text(rng, rng.randint(0, 260), letters) for _ in range(120)]
    runs, collapsed = periodic._texts([[w.encode() for w in t] for t in texts], least, times)
    want = [brute(t, least, times) for t in texts]
    assert runs == want and sum(map(len, want)) > 20
    assert [c.decode() for c in collapsed] == [collapse(t, r) for t, r in zip(texts, want)]


def test_blocks_of_extensions(monkeypatch):
    monkeypatch.setattr(periodic, "QUERIES", 50)
    rng = random.Random(9)
    texts = [text(rng, 400, "abc") for _ in range(10)]
    assert periodic._texts([[w.encode() for w in t] for t in texts], 24, 3)[0] == [brute(t) for t in texts]


def test_a_long_periodic_text():
    part = [b"w%d" % k for k in range(1000)]
    runs, collapsed = periodic._texts([part * 100 + [b"x"] + [b"y"] * 50_000], 24, 3)
    assert runs == [[(0, 100_000, 1000), (100_001, 50_000, 1)]] and len(collapsed[0].split()) == 1002


def digest(rows):
    out = []
    for doc, body in rows:
        words = re.findall("[^ \t\n\x0b\x0c\r]+", body or "")
        h = zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        lines = "".join("%d,%d,%d\n" % r for r in runs)
        out.append((doc, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
                    *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapse(words, runs)))))
    return sorted(out, key=repr)


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, " \n".join(text(rng, rng.choice([0, 5, 60, 250]), "abç")) + rng.choice(["", " \x1c z", "\xa0"])) for k in range(300)]
    rows += [(20, None), (20, "a " * 30), (20, "a " * 30), (None, "b c " * 15), (21, " \t")]
    frame(spark, rows).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if c not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    want = digest(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want and sum(r[1] for r in want) > 60


def test_odd_rows(spark, odd, none, skewed):
    found = {(r["doc_id"], r["n_words"]): r for r in periodic.periodic_runs(odd).collect()}
    assert found[1, 0]["runs"] == [] and found[1, 0]["collapsed"] == "" and found[4, 60_000]["runs"] == []
    assert periodic.periodic_runs(odd).count() == odd.count() and periodic.periodic_runs(none).count() == 0
    rows = [(r["doc_id"], r["text"].split()) for r in skewed.collect()]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.periodic_runs(skewed).collect()}
    assert got == {d: brute(w) for d, w in rows}
    assert periodic.periodic_runs(skewed).filter(F.size("runs") == 0).count() == sum(not brute(w) for _, w in rows)
