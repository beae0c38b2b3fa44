"""The inverted index against scoring every item by hand, with a term in all items, ties and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from furrow.operators import lexical_index
from furrow.session import materialise
from tests.test_retrieval import bm25_by_hand


@pytest.fixture(scope="module")
def corpus(spark):
    """Words of falling frequency; the first one in nearly every item, a tenth of the items equal."""
    rng = np.random.default_rng(11)
    p = 1 / np.arange(1, 401) ** 1.1
    docs = [(i, " ".join(f"w{t}" for t in rng.choice(400, size=rng.integers(5, 60), p=p / p.sum()))) for i in range(600)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(2000, ""), (2001, " ... "), (2002, "W0, w0 und Ünï")]
    queries = [(0, "w0"), (1, "w0 w1 w2 w3 w4"), (2, "w17 w180 w0 w1 w1"), (3, "unknown"), (4, docs[7][1]), (5, "w399 w398 w397 w0"),
               (6, " ".join(f"w{k}" for k in range(0, 400, 9))), (7, ""), (8, "ünï unknown")]
    d = spark.createDataFrame([*docs, (2003, None)], "item_id long, text string").repartition(5)
    return docs + [(2003, "")], queries, lexical_index.build_index(d), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize("k, seed_rows", [(5, 1), (5, 100), (3, 2000), (40, 50)])
def test_search_equals_scoring_everything(corpus, k, seed_rows):
    docs, queries, index, asked = corpus
    got = {}
    for r in lexical_index.search(index, asked, k, seed_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], round(r["score"], 6)))
    expected = {q: [(i, round(s, 6)) for i, s in hits] for q, hits in bm25_by_hand(queries, docs, k).items() if hits}
    assert got == expected


def test_frequent_terms_are_not_read_through(corpus):
    _, _, index, asked = corpus
    row = lexical_index.touched(index, asked.filter("query_id IN (2, 5)"), 3, 50).first()
    assert row["all"] > 1200 and row["seeds"] + row["essential"] < row["all"] / 3


def test_blocks_bound_their_postings_and_split_hot_terms(corpus):
    _, _, index, _ = corpus
    joined = index.postings.join(index.blocks, ["term", "level"])
    assert joined.count() == index.postings.count() and joined.filter("impact > top").count() == 0
    assert index.blocks.filter("term = 'w0'").count() > 5
    assert index.postings.groupBy("item_id", "term").count().filter("count > 1").count() == 0


def test_empty_tables(spark, corpus):
    _, _, index, asked = corpus
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical_index.search(lexical_index.build_index(none), asked).count() == 0
    assert lexical_index.search(index, none.withColumnRenamed("item_id", "query_id")).count() == 0


def test_words_are_counted_where_their_item_lies(spark, monkeypatch):
    """Texts move before they are split and postings once, without a sample; repeated ids still are one item."""
    plans = {}

    def seen(df, name="table"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialise(df, name)

    monkeypatch.setattr(lexical_index, "materialise", seen)
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (1, "a b a"), (None, "c d"), (3, None)], "item_id long, text string")
    index = lexical_index.build_index(docs.repartition(3))
    assert "rangepartitioning" not in plans["postings"] and plans["postings"].count("hashpartitioning") == 2
    got = {(r["item_id"], r["term"], round(r["impact"], 6)) for r in index.postings.collect()}
    impact = lambda tf, n: round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 2)), 6)
    assert got == {(1, "a", impact(4, 3)), (1, "b", impact(2, 3)), (2, "a", impact(1, 2)), (2, "c", impact(1, 2)),
                   (None, "c", impact(1, 2)), (None, "d", impact(1, 2))}


def test_postings_move_packed_and_rare_terms_stay_together(spark, monkeypatch):
    """One row a posting, with term and item spelled out, was most of the disk; a hot term still has many targets."""
    rng = np.random.default_rng(12)
    docs = [(i, "hot " + " ".join(f"t{t}" for t in rng.integers(0, 20_000, size=20))) for i in range(3_000)]
    counted = spark.createDataFrame(docs, "item_id long, text string").selectExpr(
        "explode(array_distinct(split(text, ' '))) AS term", "item_id", "1L AS tf", "21 AS length", "13 AS level").coalesce(2)
    monkeypatch.setattr(lexical_index, "PACKED_ROWS", 20_000)
    dealt = lexical_index._dealt(counted, 8)
    assert dealt.exceptAll(counted.select("term", "item_id", "tf", "length")).count() == 0 and dealt.count() == counted.count()
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange hashpartitioning(term") < plan.rindex("MapInArrow")
    homes = dealt.selectExpr("term", "spark_partition_id() AS p").distinct().groupBy("term").count()
    assert homes.filter("term <> 'hot' AND count > 1").count() == 0 and homes.filter("term = 'hot'").first()["count"] >= 4


def test_seeds_are_scored_whole(corpus):
    """A floor from partial scores left most terms essential."""
    _, _, index, asked = corpus
    wanted = materialise(lexical_index._wanted(index, asked.filter("query_id IN (4, 6)")), "wanted")
    marked = lexical_index._marked(index, wanted, 3, 400)
    found = {r["query_id"]: r["floor"] for r in marked.select("query_id", "floor").distinct().collect()}
    best = lexical_index.search(index, asked, 3).filter("rank = 3 AND query_id IN (4, 6)").collect()
    assert len(best) == 2 and all(r["score"] * 0.9 < found[r["query_id"]] <= r["score"] for r in best)


def test_texts_are_dealt_by_the_number_of_their_words(spark, monkeypatch):
    """Partitions of so many bytes of compressed texts held more words than could be counted without spilling."""
    plans = {}

    def seen(df, name="table"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialise(df, name)

    monkeypatch.setattr(lexical_index, "materialise", seen)
    monkeypatch.setattr(lexical_index, "WORDS_A_PART", 10)
    docs = spark.createDataFrame([(i, "a b c d e") for i in range(100)], "item_id long, text string")
    index = lexical_index.build_index(docs)
    assert "hashpartitioning(item_id" in plans["postings"] and plans["postings"].count(", 50), REPARTITION_BY_NUM") == 2
    assert index.postings.count() == 500
