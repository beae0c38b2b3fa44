"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.numbering import numbered

PRIME = 2147483647  # fixed value: 2^31 - 1, so products fit 62 bits
ROUNDS = 6
WALK = 64


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Multiplier, offset and second multiplier of every round, from the seed."""
    keys = []
    for k in range(ROUNDS):
        data = hashlib.sha256(f"{seed}:{k}".encode()).digest()
        keys.append(tuple(int.from_bytes(data[8 * i:8 * i + 8], "big") % (PRIME - 2) + 1 for i in range(3)))
    return keys


def sides(rows: int) -> tuple[int, int]:
    """Sides a, b of the grid on which the permutation runs: a * b is at least ``rows`` and less than rows + a."""
    a = max(1, isqrt(max(0, rows - 1)) + 1)
    return a, max(1, -(-rows // a))


def permute(n: int, rows: int, seed: int) -> int:
    """Place of row ``n`` of ``rows`` in the shuffle, in plain Python: the same law as :func:`permuted`."""
    a, b = sides(rows)
    while True:
        x, y = divmod(n, b)
        for k, (m, o, m2) in enumerate(round_keys(seed)):
            v = y if k % 2 == 0 else x
            h = (v % PRIME * m + o) % PRIME
            h = ((h ^ (h >> 15)) * m2) % PRIME
            h ^= h >> 13
            x, y = ((x + h) % a, y) if k % 2 == 0 else (x, (y + h) % b)
        n = x * b + y
        if n < rows:
            return n


def permuted(n: Column, rows: int, seed: int) -> Column:
    """Feistel permutation of 0..rows-1 with cycle walking.

    The rows are laid on an a by b grid just large enough; in alternate rounds a hash of one coordinate shifts the
    other. Places beyond the last row are permuted again until they fall inside; fewer than one place in
    sqrt(rows) is beyond, so a second step is rare and 64 steps end every walk but for a chance below 10^-60 a row on
    large tables (on tables of under 4,000 rows there are fewer than 64 places beyond, so never). A walk that had not
    ended would raise an error, not lose a row.
    """
    a, b = (F.lit(s).cast("long") for s in sides(rows))
    prime = F.lit(PRIME).cast("long")
    keys = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(o).cast("long").alias("o"),
                              F.lit(m2).cast("long").alias("m2"), F.lit(k % 2 == 0).alias("even"))
                     for k, (m, o, m2) in enumerate(round_keys(seed))])

    def one(value: Column, then) -> Column:
        """``then`` applied to a value that is computed once."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def turn(s: Column, k: Column) -> Column:
        v = F.when(k["even"], s["y"]).otherwise(s["x"])
        h = one((v % prime * k["m"] + k["o"]) % prime, lambda h: h.bitwiseXOR(F.shiftright(h, 15)) * k["m2"] % prime)
        h = one(h, lambda h: h.bitwiseXOR(F.shiftright(h, 13)))
        return one(h, lambda h: F.struct(
            F.when(k["even"], (s["x"] + h) % a).otherwise(s["x"]).alias("x"),
            F.when(k["even"], s["y"]).otherwise((s["y"] + h) % b).alias("y")))

    def once(v: Column) -> Column:
        x = ((v - v % b) / b).cast("long")  # exact: the quotient is a whole number below 2^53
        start = F.struct(x.alias("x"), (v % b).alias("y"))
        return F.aggregate(keys, start, turn, lambda s: s["x"] * b + s["y"])

    total = F.lit(rows).cast("long")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), n.cast("long"), lambda v, i: F.when(
        (i > 1) & (v < total), v).otherwise(once(v)))
    return walked


def shard(docs: DataFrame, shards: int = 40, seed: int = 42) -> DataFrame:
    """Rows (doc_id, size, text_crc32, row, place, shard, slot), one per row of ``docs``.

    ``size``: UTF-8 bytes of the text (null: none) plus 16. ``row``: the row's number in the order of doc_id, size and
    check sum (nulls first). ``place``: the Feistel permutation of it. Shard is place modulo ``shards``, slot the
    quotient: counts differ by one at most and slots have no gap. Shard and slot of a row number can be computed
    without the table. Rows that agree in all three values are alike in every column but row, place, shard, slot.
    """
    text = F.col("text").cast("binary")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                       F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"))
    rows = numbered(rows, ["doc_id", "size", "text_crc32"])
    total = rows.count()
    if not total:
        return rows.select("*", *[F.lit(0).cast("long").alias(c) for c in ("place", "shard", "slot")])
    place = permuted(F.col("row"), total, seed)
    placed = rows.withColumn("place", place)
    placed = placed.withColumn("place", F.when(F.col("place") < total, F.col("place")).otherwise(
        F.raise_error(F.lit("a cycle walk did not end"))))
    count = F.lit(shards).cast("long")
    return placed.withColumn("shard", F.col("place") % count).withColumn(
        "slot", F.expr(f"place div {shards}"))
