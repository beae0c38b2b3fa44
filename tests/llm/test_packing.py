from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from furrow.llm import packing
from furrow.session import materialise

from .conftest import ODD, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(library):
    rng = random.Random(2)
    alphabet = "aA1 \n\t'’sé漢字🙂​ \r,.!ßd"
    texts = [t for _, t in ODD if t and len(t) < 10_000] + ["<|endoftext|>", "we'll  'LL\n\n x", "  "]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(50))) for _ in range(1500)]
    encode = packing.encoder(PATH).encode_ordinary
    assert [encode(t) for t in texts] == [library(t) for t in texts]


def test_pieces_hold_added_tokens_as_the_default_call(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x  \n<|endoftext|>  y", " <|endoftext|", "plain"]
    plain = Tokenizer.from_file(PATH)
    want = {k: plain.encode(t, add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 0]
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pieces(frame(spark, texts), PATH).collect()}
    assert got == want


def test_fill_has_the_least_slack():
    rng = random.Random(4)
    for _ in range(150):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 60)
        used = packing.fill(counts, room)
        assert all(0 < n <= counts[k] for k, n in used.items())
        sums = {sum(k * n for k, n in zip(counts, take)) for take in product(*[range(c + 1) for c in counts.values()])}
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def check(rows, window, texts_by_id, library):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc, own in pieces.items():
        wanted = sorted(np.array(library(t) + [0], "<u4").tobytes() for t in texts_by_id[doc])
        runs = sorted(own, key=lambda r: (r["doc_tokens"], r["start"]))
        assert sorted(b"".join(bytes(r["ids"]) for r in runs)) == sorted(b"".join(wanted))
    assert sum(r["length"] for r in rows) == sum(len(library(t)) + 1 for ts in texts_by_id.values() for t in ts)
    return len(by_sequence)


def test_packs_skewed_documents(skewed, library):
    rows = packing.pack_documents(skewed, PATH, window=256).collect()
    texts = {r["doc_id"]: [r["text"]] for r in skewed.collect()}
    sequences = check(rows, 256, texts, library)
    tokens = sum(r["length"] for r in rows)
    assert sequences <= 1.1 * tokens / 256  # a third of the documents have one length, which few others fill up
    again = packing.pack_documents(skewed.repartition(7), PATH, window=256).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_sequences_put_the_ids_together(skewed, library):
    packed = materialise(packing.pack_documents(skewed, PATH, window=256))
    built = packing.sequences(packed)
    assert built.filter((F.octet_length("ids") != 4 * F.col("length")) | (F.col("length") > 256)).count() == 0
    assert built.agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_odd_rows(spark, odd, none, library):
    texts = {}
    for doc, text in ODD:
        texts.setdefault(doc, []).append(text)
    rows = packing.pack_documents(odd, PATH).collect()
    check(rows, 1024, texts, library)
    assert packing.pack_documents(none, PATH).count() == 0
    assert packing.pack_documents(frame(spark, ["", "", None]), PATH, window=2).agg(F.max("sequence_id")).first()[0] == 1
