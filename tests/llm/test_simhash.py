from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from furrow.llm import graph, simhash

from .conftest import ODD, union_find


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    for blank in "\t\n\x0b\f\r":
        words = [w for x in words for w in x.split(blank)]
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def near(fps):
    return [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 80)],
    [(random.Random(k).randrange(200), random.Random(k + 999).randrange(200)) for k in range(150)]])
def test_components(spark, links):
    df = spark.createDataFrame(links + [(None, 3)], "x long, y long")
    got = {r["node"]: r["root"] for r in graph.components(df, "x", "y").collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert got == union_find([(a, b) for a, b in links if a != b], nodes)


def test_state_of_very_many_links(spark):
    ids = spark.range(40_000_000).select(F.col("id").alias("u"), (-F.col("id")).alias("v"))
    count, mark = graph._state(ids)
    assert count == 40_000_000 and graph._state(ids.filter("u < 39999999")) != (count, mark)


def test_fingerprint():
    for _, text in ODD + [(0, "Ab C"), (0, "É é ÀB ab " * 400)]:
        assert simhash.fingerprint((text or "").encode()) == plain(text)


def test_links_keep_every_component(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = set(centres)
    for c in centres:
        for _ in range(12):
            bits = rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 6])) if rng.random() < 0.7 else [
                16 * rng.randrange(4) + b for b in rng.sample(range(16), 3)]
            fps.add(c ^ sum(1 << b for b in bits))
    fps |= {0, (1 << 64) - 1, 7, 0b10101 << 40}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = [(r["a"], r["b"]) for r in simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    assert union_find(links, fps) == union_find(near(fps), fps)


def test_a_run_of_n_members_gives_few_links():
    members = np.array(sorted({(1 << a) | (1 << b) for a in range(16, 63) for b in range(16)}), np.int64)
    zeros = np.zeros(len(members), np.int64)
    variant = members & ~np.int64(0xFFFF)
    order = np.argsort(variant, kind="stable")
    links = simhash.run_links(zeros[order], variant[order], members[order])
    assert len(links) <= 12 * len(members)


def test_skewed_groups(skewed):
    rows = skewed.collect()
    fps = {r["doc_id"]: plain(r["text"]) for r in rows}
    roots = union_find(near(set(fps.values())), set(fps.values()))
    least = {}
    for doc, fp in fps.items():
        least[roots[fp]] = min(doc, least.get(roots[fp], doc))
    got = simhash.near_duplicates(skewed).collect()
    assert {r["doc_id"]: (r["fp"], r["component_id"]) for r in got} == {d: (f, least[roots[f]]) for d, f in fps.items()}
    kept = simhash.keep_one(skewed)
    assert kept.columns == skewed.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert sorted(r["fp"] for r in got) == sorted(plain(t) for _, t in ODD)
    empty = {r["component_id"] for r in got if r["fp"] == 0}
    assert empty == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    groups = {r["root"] for r in got}
    assert kept.count() == len(groups)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_variants_are_dealt_by_their_number(spark, monkeypatch):
    fps = spark.range(2_000).select(F.xxhash64("id").alias("fp"))
    assert simhash.variants(fps).count() == 2_000 * simhash.VARIANTS
    found = {tuple(r) for r in simhash.link_fingerprints(fps.unionByName(fps)).collect()}
    monkeypatch.setattr(simhash, "VARIANTS_A_TASK", 10_000)
    plan = simhash.link_fingerprints(fps)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(fp" in plan and ", 40), REPARTITION_BY_NUM" in plan
    assert found == {tuple(r) for r in simhash.link_fingerprints(fps).collect()}
