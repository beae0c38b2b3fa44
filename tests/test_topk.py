"""Top-k with more queries than travel to the tasks: what is copied, and single precision that cannot tell items apart."""

from __future__ import annotations

import numpy as np
import pytest

from furrow.operators import retrieval, topk


def _frames(spark, queries, items):
    q = spark.createDataFrame([(f"q{i:03d}", v.tolist()) for i, v in enumerate(queries)], "query_id string, vector array<double>")
    c = spark.createDataFrame([(f"i{i:03d}", v.tolist()) for i, v in enumerate(items)], "item_id string, vector array<double>")
    return q.repartition(3), c.repartition(4)


def _nearest(queries, items, k, matching):
    norm = np.linalg.norm(items, axis=1)
    out = set()
    for i, v in enumerate(queries):
        s = np.round(items @ v / np.where(norm > 0, norm, 1) / (np.linalg.norm(v) or 1), 9)
        best = sorted((j for j in range(len(items)) if s[j] > 0 or not matching), key=lambda j: (-s[j], j))[:k]
        out |= {(f"q{i:03d}", f"i{j:03d}", round(float(s[j]), 7), n + 1) for n, j in enumerate(best)}
    return out


@pytest.mark.parametrize("matching", [False, True])
@pytest.mark.parametrize("layout", [{}, {"small_bytes": 1, "cell_bytes": 3_000, "cell_queries": 4, "cell_items": 9}, {"small_bytes": 1}])
def test_near_ties_copies_and_empty_vectors(spark, layout, matching):
    rng = np.random.default_rng(5)
    items = np.abs(rng.normal(size=(150, 16)))
    items[30:70] = items[30] * (1 + 1e-8 * rng.normal(size=(40, 16)))  # told apart in double precision only
    items[80:130] = items[80]  # copies
    items[[3, 140]] = 0.0
    items[141] = -items[30]
    queries = np.vstack([items[30], items[80], items[141], np.zeros(16), rng.normal(size=(30, 16))])
    q, c = _frames(spark, queries, items)
    found = retrieval.cosine_topk(q, c, 5, matching=matching, **layout).collect()
    assert {(r["query_id"], r["item_id"], round(r["score"], 7), r["rank"]) for r in found} == _nearest(queries, items, 5, matching)


def test_no_copy_of_the_queries_per_part_of_the_corpus(spark, monkeypatch):
    """Disk grew with queries x corpus; now queries move once, items are written once, and k candidates a part are left."""
    written = []

    def kept(df, name="table", **options):
        written.append((name, df.count()))
        return materialise(df, name, **options)

    materialise = topk.materialise
    monkeypatch.setattr(topk, "materialise", kept)
    rng = np.random.default_rng(6)
    q, c = _frames(spark, rng.normal(size=(60, 4)), rng.normal(size=(200, 4)))
    found = retrieval.cosine_topk(q, c, 2, small_bytes=1, cell_bytes=60 * 48 // 6, cell_items=10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "Union" not in plan
    # one for the queries and one for the candidates
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    assert [name for name, _ in written] == ["packed"] and written[0][1] <= 24
    assert found.count() == 120


def test_blocks_are_bounded_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1_000_000] * 40})
    rows = [pa.ipc.open_stream(b).read_all().num_rows for b in topk._blocks(batch, 1_000)]
    assert sum(rows) == 40 and max(rows) <= topk.BLOCK_BYTES / 1_000_000
