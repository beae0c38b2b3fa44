"""Stored tables follow their input files."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.session import stored, versions


def test_a_replaced_file_is_noticed(spark, tmp_path):
    path = str(tmp_path / "a folder" / "t.parquet")
    calls = []

    def total():
        given = spark.read.parquet(path)

        def build():
            calls.append(1)
            return given.agg(F.sum("id").alias("s"))

        return stored("total", [given], build).first()["s"]

    def replace(n):
        spark.range(n).toPandas().to_parquet(path)

    (tmp_path / "a folder").mkdir()
    replace(10)
    assert (total(), total(), len(calls)) == (45, 45, 1)
    replace(100)
    assert (total(), total(), len(calls)) == (4950, 4950, 2)


def test_frames_without_files(spark):
    assert versions([spark.range(3)]) == (0, 0)
    assert stored("none", [spark.range(3)], lambda: spark.range(3)).count() == 3
