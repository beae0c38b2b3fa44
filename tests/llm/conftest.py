from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(30_000))
LINE = "A line that five documents or more have in common, long enough"


def frame(spark, texts, first: int = 0):
    """Documents with consecutive doc_ids; a text may be a pair of doc_id and text."""
    rows = [t if isinstance(t, tuple) else (first + k, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(
        [(d, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (d, t) in enumerate(rows)], FIELDS)


ODD = [
    (1, None), (2, ""), (3, " \t\n \x0b\r"), (4, LONG), (5, "one two three four five six"), (6, "one two three four five six"),
    (6, "one two three four five six"), (6, "another text of the same number"), (None, "a row without a number"), (None, None),
    (7, "▁ é 漢字 🙂 ​ Ünï\n\n\ncöde"), (8, "a" * 5000), (9, "1" * 5000), (10, "a.b@" * 2000), (11, "x\u0000y"),
    (-5, "negative number of a document"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    rows = [(d, t, None, None, None) for d, t in ODD]
    df = spark.createDataFrame(rows, FIELDS)
    for name in ("fp", "tid", "row", "score", "shard", "slot", "root", "component_id", "drops", "label", "key", "_id", "n",
                 "spans", "n_lines", "ids", "length", "a b"):
        df = df.withColumn(name, F.lit(None).cast("int"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    """The same columns without rows."""
    return odd.filter("false")


@pytest.fixture(scope="session")
def skewed(spark):
    """A third of the rows is one text, another third near copies of one text that share a line; the rest differs."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    body = rng.choices(words, k=300)
    texts = ["the same text in very many documents, word for word and line for line"] * 60
    for _ in range(60):
        near = list(body)
        near[rng.randrange(300)] = rng.choice(words)
        texts.append(" ".join(near) + "\n" + LINE)
    for _ in range(60):
        texts.append("\n".join(" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 6))))
    rng.shuffle(texts)
    return frame(spark, texts)


def union_find(links, nodes):
    """Smallest reachable node of each node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
