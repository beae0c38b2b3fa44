from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from furrow.llm import sharding
from furrow.llm.numbering import numbered

from .conftest import ODD


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 16, 17, 50, 97, 1000])
def test_permutation(rows):
    assert sorted(sharding.permute(n, rows, 42) for n in range(rows)) == list(range(rows))


def _place(rows, seed):
    return sharding.permuted(F.col("id"), rows, seed)


def test_column_follows_the_law(spark):
    for rows, seed in ((1, 1), (7, 42), (500, 3)):
        got = [r["p"] for r in spark.range(rows).withColumn("p", _place(rows, seed)).orderBy("id").collect()]
        assert got == [sharding.permute(n, rows, seed) for n in range(rows)]


def test_large_tables_stay_in_range(spark):
    rows = 10 ** 12 + 39
    df = spark.range(rows - 300, rows).withColumn("p", _place(rows, 42))
    got = [(r["id"], r["p"]) for r in df.collect()]
    assert all(p == sharding.permute(n, rows, 42) and 0 <= p < rows for n, p in got)


def test_row_numbers(spark):
    df = spark.range(1000).selectExpr("CAST(id * 7919 % 1000 AS INT) AS x", "id % 3 AS y").repartition(9)
    got = sorted((r["row"], r["x"]) for r in numbered(df, ["x", "y"]).collect())
    assert got == [(k, k) for k in range(1000)]


def test_shards(skewed):
    rows = sharding.shard(skewed, 7).collect()
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    again = sharding.shard(skewed.repartition(5), 7).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    for number, r in enumerate(sorted(rows, key=lambda r: r["doc_id"])):
        place = sharding.permute(number, len(rows), 42)
        assert (r["shard"], r["slot"]) == (place % 7, place // 7)


def test_odd_rows(odd, none):
    rows = sharding.shard(odd, 4).collect()
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in ODD)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    assert sorted(r["place"] for r in rows) == list(range(len(ODD)))
    assert sharding.shard(none, 4).count() == 0
