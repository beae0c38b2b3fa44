"""Chunking, exact quantiles and rankings against brute force, with skewed data."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.config import Chunking
from furrow.functions.text import window_bounds
from furrow.operators import retrieval
from furrow.operators.quantiles import exact_quantiles, grouped_quantiles
from furrow.operators.topk import best_k


def _windows(text, size, overlap):
    return [p for p in (text[a:b].strip() for a, b in window_bounds(text, size, overlap)) if p]


def test_tail_window_repeats_the_end():
    text = "x" * 1000
    assert [len(c) for c in _windows(text, 1000, 200)] == [1000, 200]
    assert _windows("short", 1000, 200) == ["short"]
    assert _windows("   \n ", 1000, 200) == []
    assert _windows("", 1000, 200) == []


def test_cut_prefers_priority_not_position():
    # a '. ' past the half window wins over a later '! '
    text = "a" * 600 + ". " + "b" * 200 + "! " + "c" * 600
    assert _windows(text, 1000, 200)[0] == "a" * 600 + "."
    # exactly at the half window is not far enough
    text = "a" * 500 + ". " + "b" * 900
    assert len(_windows(text, 1000, 200)[0]) == 1000
    text = "a" * 501 + ".\n" + "b" * 900
    assert _windows(text, 1000, 200)[0] == "a" * 501 + "."


def test_pieces_are_cut_where_the_text_is(spark):
    """The Python step returns places; characters beyond 16 bits and odd blanks count as Python counts them."""
    texts = ["\u3000 x\U0001F33D" * 400 + ". " + "y" * 900 + " \x1c", "\u00a0\u2003", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = retrieval.chunk(df)
    got = [(r["doc_id"], r["text"]) for r in found.orderBy("doc_id", "chunk_index").collect()]
    assert got == [(i, p) for i, t in enumerate(texts) for p in _windows(t or "", 1000, 200)] and len(got) > 2
    assert "array<struct" in str(found._jdf.queryExecution().optimizedPlan().toString()) or "begin" in found._jdf.queryExecution().toString()


def test_arguments_that_do_not_advance():
    with pytest.raises(ValueError):
        Chunking(size=200, overlap=200)
    with pytest.raises(ValueError):
        Chunking(size=390, overlap=200)
    Chunking(size=400, overlap=200)


def test_sentence_chunks_of_odd_texts(spark):
    texts = [None, "", " \n\t ", "a" * 800 + "\n\t" * 200, "One. " * 500, "é漢🙂 " * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in retrieval.chunk(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: _windows(t, 1000, 200) for i, t in enumerate(texts) if t and t.strip()}
    fixed = retrieval.chunk(df.filter("doc_id = 3"), sentence=False).collect()
    assert [r["text"] for r in fixed] == ["a" * 800]


def test_fixed_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2500))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "é" * 900)], "doc_id long, text string")
    got = {(r["doc_id"], r["chunk_index"]): r["text"] for r in retrieval.chunk(df, sentence=False).collect()}
    assert got[1, 0] == text[:1000] and got[1, 1] == text[800:1800] and got[1, 3] == text[2400:]
    assert (2, 0) not in got and len(got[3, 1]) == 100


@pytest.mark.parametrize("read_off", [5_000, 10, 1])
def test_exact_quantiles(spark, read_off):
    rng = np.random.default_rng(1)
    # a third of the rows share one value
    x = np.concatenate([np.full(700, 3.25), rng.exponential(5.0, 1400)])
    rows = [(float(v), None if i % 5 == 0 else float(i)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(5)
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = exact_quantiles(df, ["x", "y"], probs, read_off)
    assert got["x"] == pytest.approx(np.quantile(x, probs).tolist())
    assert got["y"] == pytest.approx(np.quantile([r[1] for r in rows if r[1] is not None], probs).tolist())


@pytest.mark.parametrize("read_off", [5_000, 3])
def test_quantiles_end_on_odd_values(spark, read_off):
    inf, nan = math.inf, math.nan
    values = [-inf, -inf, -1e308, 0.0, 5e-324, 1e-300, 1.0, 2.0, 1e308, inf] + [nan, None, nan]
    rows = [("a", v) for v in values] + [("b", float(k)) for k in range(900)] + [(None, 7.0), ("c", None)]
    df = spark.createDataFrame(rows, "kind string, x double").repartition(3)
    got = grouped_quantiles(df, ["x"], (0.0, 0.25, 0.5, 1.0), group="kind", read_off=read_off)
    finite = [v for v in values if v is not None and not math.isnan(v)]
    assert got["a", "x"][0] == -inf and got["a", "x"][3] == inf
    assert got["a", "x"][2] == pytest.approx((sorted(finite)[4] + sorted(finite)[5]) / 2)
    assert got["b", "x"] == pytest.approx(np.quantile(np.arange(900), (0.0, 0.25, 0.5, 1.0)).tolist())
    assert got[None, "x"] == [7.0] * 4 and ("c", "x") not in got


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], (0.25, 0.75)) == {"x": [None, None]}


# queries that travel, and cells of a few rows or a few bytes
LAYOUTS = [{}, {"small_bytes": 1, "cell_queries": 3, "cell_items": 7}, {"small_bytes": 1, "cell_bytes": 500}]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_cosine_against_brute_force(spark, layout):
    rng = np.random.default_rng(2)
    items = rng.normal(size=(60, 8))
    items[20:40] = items[20]  # a third of the items are copies
    items[5] = 0.0
    queries = rng.normal(size=(9, 8))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id long, vector array<double>").repartition(4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")
    got = {}
    for r in retrieval.cosine_topk(q, c, 5, **layout).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], round(r["score"], 6)))
    norm = np.linalg.norm(items, axis=1)
    for i, v in enumerate(queries):
        s = np.round(items @ v / np.where(norm > 0, norm, 1) / np.linalg.norm(v), 9)
        best = sorted(range(60), key=lambda j: (-s[j], j))[:5]
        assert got[i] == [(j, round(float(s[j]), 6)) for j in best]


def bm25_by_hand(queries, docs, k, k1=1.2, b=0.75):
    tokens = {i: re.findall(r"\w+", t.lower()) for i, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(t for w in tokens.values() for t in set(w))
    out = {}
    for qid, text in queries:
        scores = {}
        for i, w in tokens.items():
            tf = Counter(w)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1)
                    / (tf[t] + k1 * (1 - b + b * len(w) / avg)) for t in set(re.findall(r"\w+", text.lower())) if t in tf)
            if s > 0:
                scores[i] = round(s, 9)
        out[qid] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("layout", LAYOUTS)
def test_bm25_against_brute_force(spark, layout):
    rng = np.random.default_rng(3)
    vocabulary = ["corn", "heat", "rain", "soil", "yield", "stress", "ndvi", "water"]
    docs = [(i, " ".join(rng.choice(vocabulary, size=rng.integers(1, 30)))) for i in range(40)]
    docs += [(100 + i, "Corn, corn and WATER!") for i in range(20)] + [(200, ""), (201, "...")]
    queries = [(0, "water stress"), (1, "corn"), (2, "unknown"), (3, "rain rain soil"), (4, "heat yield ndvi water corn")]
    d = spark.createDataFrame(docs, "item_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, text string")
    got = {}
    for r in retrieval.bm25(q, d, 4, **layout).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    expected = {k: v for k, v in bm25_by_hand(queries, docs, 4).items() if v}
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in expected.items()}
    for k, v in expected.items():
        assert [s for _, s in got[k]] == pytest.approx([s for _, s in v])


def test_only_requests_bound_k(spark):
    with pytest.raises(ValueError):
        retrieval.check_k(21)
    q = spark.createDataFrame([("q", [1.0, 0.5])], "query_id string, vector array<double>")
    c = spark.createDataFrame([(f"i{k:02d}", [1.0, float(k)], "a" if k % 2 else "b") for k in range(40)] + [("z", [-1.0, 0.0], "a")],
                              "item_id string, vector array<double>, collection string")
    assert retrieval.cosine_topk(q, c, 30).count() == 30
    found = retrieval.cosine_topk(q, c, 40, collection="a").orderBy("rank").collect()
    assert len(found) == 21 and found[-1]["item_id"] == "z" and {r["item_id"] for r in found[:-1]} == {f"i{k:02d}" for k in range(1, 40, 2)}
    assert retrieval.cosine_topk(q, c, 40, collection="a", matching=True).count() == 20


def test_ties_go_by_id_of_any_type():
    import pyarrow as pa

    scores = np.array([[1.0, 2.0, 1.0, 1.0]])
    got = best_k(scores, pa.array(["q"]), pa.array(["d", "c", "b", "a"]), 3)
    assert got["item_id"].to_pylist() == ["c", "a", "b"]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, item_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id long, item_id long, rank int")
    got = {r["item_id"]: r["rrf_score"] for r in retrieval.rrf(a, b).collect()}
    assert got == {10: pytest.approx(1 / 61), 11: pytest.approx(1 / 62 + 1 / 61)}


def test_embeddings_are_unit_and_weighted(spark):
    df = spark.createDataFrame([(1, "corn heat heat"), (2, "corn rain"), (3, "!!!")], "doc_id long, text string")
    rows = {r["doc_id"]: np.array(r["embedding"]) for r in retrieval.embed(df, dim=64)[0].collect()}
    assert np.linalg.norm(rows[1]) == pytest.approx(1.0, abs=1e-6) and np.linalg.norm(rows[3]) == 0.0
    assert len({retrieval.term_bucket(w, 64) for w in ("corn", "heat", "rain")}) == 3
    idf = {"corn": math.log(4 / 3), "heat": math.log(4 / 2), "rain": math.log(4 / 2)}
    weights = np.array([idf["corn"], 2 * idf["heat"]])
    assert sorted(rows[1][rows[1] > 0]) == pytest.approx(sorted(weights / np.linalg.norm(weights)), abs=1e-6)


def test_a_corpus_is_counted_once(spark):
    df = spark.createDataFrame([(1, "corn heat"), (2, None), (3, "!!!")], "doc_id long, text string").filter("doc_id <> 2")
    found, weights = retrieval.embed(df, dim=8)
    assert "EvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sum(w == pytest.approx(math.log(3)) for w in weights) >= 6
    assert set(retrieval.embed(df.filter("false"), dim=8)[1]) == {0.0}


def contexts(spark, **over):
    row = {"request_id": 1, "message": "How dry is it?", "fips": "19001", "has_stress": True, "has_yield": True,
           "county_name": "Adair", "week_start": "2025-08-01", "week_of_season": 14, "overall_stress": 16.29,
           "water_stress": 8.42, "heat_stress": None, "vegetation_health": 60.62, "atmospheric_stress": 7.91,
           "ndvi_raw": 0.375, "lst_raw": 30.0, "vpd_raw": 1.0, "water_raw": -3.24, "predicted_yield": 190.0,
           "yield_uncertainty": 8.0, "confidence_lower": 182.0, "confidence_upper": 198.0, "primary_driver": "Heat stress"}
    row.update(over)
    kinds = {"request_id": "long", "week_of_season": "int", "has_stress": "boolean", "has_yield": "boolean"}
    texts = ("message", "fips", "county_name", "week_start", "primary_driver")
    schema = ", ".join(f"{k} {kinds.get(k, 'string' if k in texts else 'double')}" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema)


def test_prompt_parts(spark):
    hits = spark.createDataFrame([(1, 2, "second"), (1, 1, "f" * 2995)], "request_id long, rank int, text string")
    r = retrieval.assemble_prompts(contexts(spark), hits).first()
    assert r["has_live_data"] and r["sources_used"] == 2
    assert r["prompt"].startswith("User Question: How dry is it?\n\n\nLIVE STRESS DATA")
    assert "- Heat Stress: N/A\n" in r["prompt"] and "Confidence: [182.0, 198.0]" in r["prompt"]
    assert "f" * 2995 + "\n\n---\n... (truncated)" in r["prompt"] and "second" not in r["prompt"]


def test_prompt_without_documents_or_live_data(spark):
    none = spark.createDataFrame([], "request_id long, rank int, text string")
    r = retrieval.assemble_prompts(contexts(spark, has_stress=False, has_yield=False), none).first()
    assert not r["has_live_data"] and r["sources_used"] == 0
    assert "LIVE" not in r["prompt"].split("Prioritize")[0] and "No relevant documents found" in r["prompt"]


def test_client_values_win_only_when_truthy(spark):
    req = spark.createDataFrame(
        [(1, "m", "1", 5, True, 12.0, None, None, None, None, 0.0, 3.0), (2, "m", None, 5, True, 1.0, None, None, None, None, 9.0, 9.0),
         (3, "m", "1", 5, False, None, None, None, None, None, None, None)],
        "request_id long, message string, fips string, week int, include_live_data boolean, overall_stress double, water_stress double, "
        "heat_stress double, vegetation_health double, atmospheric_stress double, predicted_yield double, yield_uncertainty double")
    sub = F.struct(F.lit(33.0).alias("value"))
    near = req.select("request_id", F.lit("Adair").alias("county_name"), F.lit("2020-06-01").cast("date").alias("week_start"),
                      F.lit(5).alias("week_of_season"), F.lit(50.0).alias("overall_stress_index"),
                      F.create_map(F.lit("ndvi_mean"), F.lit(0.5)).alias("indicators"),
                      *[sub.alias(c) for c in ("water_stress_index", "heat_stress_index", "vegetation_health_index", "atmospheric_stress_index")])
    fc = req.select("request_id", F.lit(180.0).alias("predicted_yield"), F.lit(15.0).alias("confidence_interval"),
                    F.lit(165.0).alias("confidence_lower"), F.lit(195.0).alias("confidence_upper"), F.lit("x").alias("primary_driver"))
    got = {r["request_id"]: r for r in retrieval.chat_context(req, near, fc).collect()}
    assert (got[1]["overall_stress"], got[1]["water_stress"]) == (12.0, 33.0)
    assert (got[1]["predicted_yield"], got[1]["yield_uncertainty"]) == (180.0, 3.0)
    assert not got[2]["has_stress"] and not got[3]["has_stress"] and got[3]["predicted_yield"] is None
    only = {r["request_id"]: r for r in retrieval.chat_context(req, near, fc, client_only=True).collect()}
    assert only[1]["water_stress"] is None


def _bounded(most_queries, most_items):
    """A kernel of ones that fails on blocks over its bounds."""
    import pyarrow as pa

    def kernel(queries, items, k):
        if queries.num_rows > most_queries or items.num_rows > most_items:
            raise AssertionError(f"a block of {queries.num_rows} x {items.num_rows}")
        return best_k(np.ones((queries.num_rows, items.num_rows)), queries["query_id"].combine_chunks(),
                      pa.chunked_array(items["item_id"]).combine_chunks(), k)

    return kernel


@pytest.mark.parametrize("layout", [{}, {"small_bytes": 1, "cell_bytes": 300}])
def test_no_task_scores_more_than_a_block(spark, layout):
    """All queries at once against a batch took gigabytes; a corpus row is dealt once, whatever the number of queries."""
    from pyspark.sql import functions as F

    from furrow.operators.topk import blockwise_topk

    queries = spark.range(20).withColumnRenamed("id", "query_id")
    corpus = spark.range(30).withColumnRenamed("id", "item_id")
    found = blockwise_topk(queries, corpus, _bounded(4, 5), 3, F.lit(8), F.lit(8), cell_queries=4, cell_items=5, **layout)
    assert [tuple(r) for r in found.orderBy("query_id", "rank").select("query_id", "item_id").collect()] == [
        (q, i) for q in range(20) for i in range(3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == (1 if layout else 0)
