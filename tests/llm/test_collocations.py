from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import collocations, quotient, wordchunks

from .conftest import frame


@pytest.mark.parametrize("bits", [1, 3, 9, 21, 22, 32])
def test_permutation_is_inverted(bits):
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 1 << bits, 999, np.uint64), rng.integers(0, 1 << 2 * bits, 999, np.uint64, endpoint=False) \
        if bits < 32 else rng.integers(0, 2**64 - 1, 999, np.uint64, endpoint=True)
    there = quotient.permute(left, right, bits)
    assert max(there[0]) < 1 << bits and int(max(there[1])) < 1 << 2 * bits
    back = quotient.permute(*there, bits, back=True)
    assert (back[0] == left).all() and (back[1] == right).all()
    if bits == 3:
        whole = np.arange(8, dtype=np.uint64).repeat(64), np.tile(np.arange(64, dtype=np.uint64), 8)
        assert len(set(zip(*(x.tolist() for x in quotient.permute(*whole, 3))))) == 512


@pytest.mark.parametrize("bits", [2, 7, 20, 25, 32])
def test_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    top = min(bits, 3)
    prefix, want, parts = top, Counter(), []
    for size in (0, 1, 700, 2000):
        left = rng.integers(0, min(1 << bits - prefix, 50), size).astype(np.uint64) | np.uint64(1 << bits - 1)
        left = left & ~np.uint64(((1 << prefix) - 1) << bits - prefix) | np.uint64(1 << bits - 1)
        right = rng.integers(0, min(1 << 2 * bits, 40), size).astype(np.uint64)
        times = rng.choice([1, 2, 256, 257, 258, 5_000_000_000], size)
        for key in zip(left.tolist(), right.tolist(), times.tolist()):
            want[key[:2]] += key[2]
        own = quotient.tally(left, right, times, bits)
        data = quotient.encode(own, bits, prefix)
        back = quotient.decode(data, bits, 1 << prefix - 1)
        assert all((x == y).all() for x, y in zip(own, back))
        parts.append(data)
    left, right, times = quotient.merge(parts, bits, 1 << prefix - 1)
    assert dict(zip(zip(left.tolist(), right.tolist()), times.tolist())) == dict(want)
    assert sorted(zip(left.tolist(), right.tolist())) == list(zip(left.tolist(), right.tolist()))


def test_unit_counts_equal_given_ones():
    rng = np.random.default_rng(3)
    for bits in (5, 30):
        left, right = rng.integers(0, 9, 500).astype(np.uint64), rng.integers(0, 9, 500).astype(np.uint64)
        one, other = quotient.tally(left, right, None, bits), quotient.tally(left, right, np.ones(500, np.int64), bits)
        assert all((a == b).all() for a, b in zip(one, other)) and one[2].sum() == 500


def brute(rows, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i:i + k])] += 1
    out = []
    for lang, own in f.items():
        found = []
        for g, a in own.items():
            if len(g) < 2 or a < least:
                continue
            cuts = [(1_000_000 * a * a // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            longer = [b for h, b in own.items() if len(h) == 3 and b >= least and g in (h[:2], h[1:])] if len(g) == 2 else []
            if not any(100 * b >= share * a for b in longer):
                found.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def corpus(seed, size):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abCé", k=rng.randint(1, 3))) for _ in range(12)]
    marks = [" ", " ", " ", "\t", "  ", ". ", "\n", "!", " \x0b", "\xa0", "\x1c"]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 40))))
            for _ in range(size)]


def docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", 0) for k, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def test_against_brute_force(spark):
    rows = corpus(7, 900) + [("fr", "the same pair " * 500)] * 3
    want = brute(rows)
    assert len(want) > 100 and got(collocations.collocations(docs(spark, rows))) == want


def test_small_chunks_flushes_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 64)
    rows = corpus(8, 200)
    whole = wordchunks.chunks(docs(spark, rows), collocations.phrase_words, F.lit("x"), F.lit(True), 50)
    assert whole.count() > 20
    assert got(collocations.collocations(docs(spark, rows), 5, 30, 40)) == brute(rows, 5, 30, 40)


def test_odd_rows(spark, odd, none, skewed):
    odd = odd.unionByName(odd.filter("doc_id = 5").withColumn("text", F.lit("one two three " * 20)))
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    found = got(collocations.collocations(odd))
    assert found == brute(rows) and {r[0] for r in found} == {"und"}
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(frame(spark, ["", None, "a b"])).count() == 0
    assert got(collocations.collocations(skewed)) == brute([(r["lang"], r["text"]) for r in skewed.collect()])
