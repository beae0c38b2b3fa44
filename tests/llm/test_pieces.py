from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from furrow.llm import pieces

from .conftest import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(PATH, 0.5)


def test_posterior_of_a_word(vocab):
    word, n = " then", 100_000
    lattice = pieces.Lattice(vocab, [word])
    ids, counts = lattice.sample(np.zeros(n, np.int64), pieces._mix(np.arange(n).astype(np.uint64)))
    ends = np.cumsum(counts)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(np.r_[0, ends[:-1]], ends))
    known = {vocab.bytes[i].decode(): (i, w) for i, w in zip(vocab.ids.tolist(), vocab.weights.tolist()) if i >= 0}

    def paths(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in known:
                i, w = known[rest[:k]]
                for ids, weight in paths(rest[k:]):
                    yield (i, *ids), w + weight

    weights = {ids: np.exp(w) for ids, w in paths(word)}
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    assert max(abs(weights[i] / total - seen[i] / n) for i in weights) < 0.01
    assert abs(np.log(total) - lattice.alpha[lattice.last[0]]) < 1e-9


def test_round_trip_and_keys(vocab):
    texts = [t or "" for _, t in ODD] + ["  lead", "trail  ", " ", "\n", "▁", "tab\there", "é" * 300]
    keys = pieces.row_keys(list(range(len(texts))), 42)
    found = pieces.segment_texts(vocab, texts, keys)
    assert [vocab.decode(f.tolist()) for f in found] == texts
    for k in (0, 4, 9):  # a text alone gives what it gives among others
        alone = pieces.segment_texts(vocab, [texts[k]], keys[k:k + 1])[0]
        assert alone.tolist() == found[k].tolist()
    other = pieces.segment_texts(vocab, texts, pieces.row_keys(list(range(len(texts))), 43))
    assert any(a.tolist() != b.tolist() for a, b in zip(found, other))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [library.decode(f.tolist()) for f in found[4:6]] == texts[4:6]


def test_rows(odd, none, skewed):
    once = sorted(((repr(r["doc_id"]), bytes(r["ids"])) for r in pieces.encode(skewed, PATH).collect()))
    small = sorted(((repr(r["doc_id"]), bytes(r["ids"])) for r in pieces.encode(skewed.repartition(5), PATH, block=500).collect()))
    assert once == small
    encoded = pieces.encode(odd, PATH)
    assert all(r["lossless"] for r in encoded.collect())
    back = sorted(((repr(r["doc_id"]), r["text"]) for r in pieces.decode(encoded, PATH).collect()))
    assert back == sorted((repr(d), t or "") for d, t in ODD)
    assert pieces.encode(none, PATH).count() == 0 and pieces.decode(pieces.encode(none, PATH), PATH).count() == 0


def test_keys_of_the_least_and_greatest_number():
    ends = [-(1 << 63), -1, None, 0, (1 << 63) - 1]
    keys = pieces.row_keys(ends, 42)
    assert len(keys) == 5 and keys[1] == keys[2] and len(set(keys.tolist())) == 4
