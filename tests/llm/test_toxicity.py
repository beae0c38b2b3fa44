from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from furrow.llm import toxicity
from furrow.llm.toxicity import Lexicon

from .conftest import ODD, frame


@pytest.mark.parametrize("text, folded", [
    ("IDIOT", "idiot"), ("1d10t", "idiot"), ("ïdîòt", "idiot"), ("іdіоt", "idiot"), ("i​diot", "idiot"), ("ｉｄｉｏｔ", "idiot"),
    ("$cum t@ke m@n", "$cum take man"), ("a$s!n", "assin"), ("Øh!!", "oh!!"), ("", ""), ("漢字", "漢字"),
])
def test_fold(text, folded):
    assert toxicity.fold(text) == folded


def test_matches_at_word_starts_and_spares_exceptions():
    lexicon = Lexicon({"clown ": 5.0, "scum": 4.0}, exceptions=("clown fish",))
    assert lexicon.measure("You CL0WN, you scummy one") == (9.0, 2, 5)
    assert lexicon.measure("clowns unscum") == (0, 0, 2)
    assert lexicon.measure("a clown fish and a clown") == (5.0, 1, 6)
    assert lexicon.measure("clown fishes") == (5.0, 1, 2)
    assert lexicon.measure("") == (0, 0, 0)
    assert Lexicon({}, exceptions=()).measure("clown") == (0, 0, 1)


def brute(lexicon, text):
    folded, hits = toxicity.fold(text), {}
    spared = []
    for phrase in lexicon.exceptions:
        p = toxicity.fold(phrase)
        at = folded.find(p)
        while at >= 0:
            closed = at + len(p) == len(folded) or not folded[at + len(p)].isalnum()
            if closed and (at == 0 or not folded[at - 1].isalnum()):
                spared.append((at, at + len(p)))
            at = folded.find(p, at + 1)
    for term, weight in lexicon.terms.items():
        word = term.rstrip(" ")
        at = folded.find(word)
        while at >= 0:
            end = at + len(word)
            closed = end == len(folded) or not folded[end].isalnum()
            if (at == 0 or not folded[at - 1].isalnum()) and (closed or not term.endswith(" ")):
                hits[at] = max(weight, hits.get(at, 0))
            at = folded.find(word, at + 1)
    kept = [w for b, w in hits.items() if not any(s <= b < e for s, e in spared)]
    return sum(kept), len(kept), len(text.split())


def test_machine_against_search():
    rng = random.Random(8)
    lexicon = Lexicon({"ab": 1.0, "aba ": 2.0, "ba": 4.0, "b ": 8.0, "abab": 16.0}, exceptions=("ab a", "b b"))
    for _ in range(600):
        text = "".join(rng.choices("abAB .4", k=rng.randrange(30)))
        assert lexicon.measure(text) == brute(lexicon, text)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 9))) for _ in range(800)]
    bad = ["idiot", "scum", "grobian", "grobianisch"]
    texts, labels = [], []
    for k in range(900):
        body = rng.choices(words, k=rng.randint(20, 200))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                body.insert(rng.randrange(len(body)), rng.choice([bad[0], bad[1], bad[2] + rng.choice(["", "isch", "e", "en"])]))
        texts.append(" ".join(body))
        labels.append((k, 1, int(toxic)))
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, c) for a, _, c in labels)


def test_learns_and_scores_held_out_rows(corpus):
    docs, labels, truth = corpus
    lexicon = toxicity.learn(docs, labels)
    assert {"idiot ", "scum "} <= set(lexicon.terms) and any(t.startswith("grob") for t in lexicon.terms)
    rows = toxicity.toxicity(docs, lexicon).select("doc_id", "score", toxicity.held_out(F.col("doc_id")).alias("out")).collect()
    out = [r for r in rows if r["out"]]
    assert {r["doc_id"] for r in out} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert all((r["score"] >= 0.7) == bool(truth[r["doc_id"]]) for r in out)
    kept = toxicity.keep_clean(docs, lexicon)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["score"] < 0.7}


def test_held_out_labels_are_not_used(corpus):
    docs, labels, _ = corpus
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.learn(docs, labels), toxicity.learn(docs.repartition(3), flipped)
    assert one.terms == two.terms and one.model == pytest.approx(two.model)


def test_odd_rows(spark, odd, none, corpus):
    docs, labels, _ = corpus
    lexicon = toxicity.learn(docs, labels)
    rows = toxicity.toxicity(odd, lexicon).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] < 0.7 for r in rows)
    assert toxicity.keep_clean(odd, lexicon).columns == odd.columns
    assert toxicity.keep_clean(odd, lexicon).count() == len(ODD)
    assert toxicity.toxicity(none, lexicon).count() == 0
    bare = toxicity.learn(none, labels.filter("false"))
    assert bare.terms == {} and toxicity.toxicity(odd, bare).filter("score >= 0.5").count() == 0
    nulls = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0), (4, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, toxicity.learn(odd, nulls)).count() == len(ODD)
