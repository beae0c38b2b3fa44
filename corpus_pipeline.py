"""A corpus from raw documents to packed sequences, each stage written and read again.

Every stage takes null, empty and very long texts, null and repeated doc_ids, repeated rows and further columns, and
gives an empty table for an empty one; the docstrings say what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import linededup, packing, pii, shinglegroups, toxicity
from furrow.llm.queries import VOCABULARY, table
from furrow.session import new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon does not reject; a null or empty text is scored like a text without terms."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; a document may be left empty, and a null text becomes empty."""
    kept = linededup.dedup_lines(docs)
    sizes = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", sizes).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, verified similarity of 0.8 or more.

    The smallest doc_id stays, a null one only where there is no other; texts without a word are one group.
    """
    return shinglegroups.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; a null text stays null, every row stays."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids and their sequences of 1024 tokens; a null or empty text is its end id."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", redact),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            path = new_path(spark, name.replace(" ", "-"))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
