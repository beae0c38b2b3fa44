"""Quality rules kept as a ledger: every rule is evaluated once, policies and ablations read the stored bits.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import materialise

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def _rules() -> dict[str, Column]:
    """Failing condition of every rule over the measurements, in the order of the bits; new rules go to the end."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "few_words": words < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * words,
        "many_symbols": 10 * F.col("n_symbols") > 3 * words,
        "duplicate_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "short_words": chars < 2 * words,
        "long_words": chars > 20 * words,
        "many_words": words > 1_000_000,
        "shouting": 2 * F.col("n_shouted") > words,
    }


RULES = ("few_words", "repeated_words", "many_symbols", "duplicate_lines", "short_words", "long_words", "many_words",
         "shouting")


@dataclass(frozen=True)
class Policy:
    """A version of the rules that are enforced; a document is kept if it fails none of them."""

    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.name: p for p in (
    BASE,
    Policy("v1", (*BASE.rules, "many_symbols", "duplicate_lines")),
    Policy("v2", RULES),
)}
CURRENT = POLICIES["v2"]


def measure(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouted) as long.

    Words are runs without the six ASCII white-space characters. ``n_repeat_words`` counts the words inside 3-word
    windows that the text holds twice or more; windows are compared by 64-bit hash within one text. ``n_lines`` are
    lines with a word; ``n_shouted`` counts "!!". A null or empty text has zero of everything. Nothing is
    shuffled: each row is measured where it is read.
    """
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", F.array_remove(F.split(text, f"{SPACE}+"), "").alias("words"), lines.alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"), F.expr("(length(text) - length(replace(text, '!!', ''))) div 2").alias("n_shouted"))
    words = F.col("words")
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    rows = rows.select(
        "doc_id", F.size(words).alias("n_words"), F.length(F.array_join(words, "")).alias("word_chars"), "n_symbols",
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        "n_shouted", F.when(F.size(words) >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"))
    windows = F.col("windows")
    ordered = F.array_sort(F.transform(windows, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    twice = F.size(F.array_distinct(windows)) < F.size(windows)
    rows = rows.withColumn("ordered", F.when(twice, ordered)).drop("windows")
    ordered = F.col("ordered")
    again = F.filter(ordered, lambda s, i: ((i > 0) & (F.get(ordered, i - 1)["k"] == s["k"]))
                     | F.coalesce(F.get(ordered, i + 1)["k"] == s["k"], F.lit(False)))
    rows = rows.withColumn("at", F.array_sort(F.transform(again, lambda s: s["i"]))).drop("ordered")
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
                          F.lit(0), lambda s, x: s + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted")
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in names])


def ledger(docs: DataFrame) -> DataFrame:
    """:func:`measure` with ``failed``: bit i is set if the i-th rule of :data:`RULES` fails.

    The ledger is a written table: the texts are measured once, and policies and ablations read a few numbers a row.
    """
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(_rules().values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return materialise(measure(docs).withColumn("failed", total.cast("long")), "ledger")


def passes(policy: Policy) -> Column:
    """Whether a ledger row is kept by a policy version."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Rows (rule, failed, alone, kept_without), one per rule of the policy, from the ledger's bits.

    ``failed``: documents that fail the rule; ``alone``: those that fail no other rule of the policy; ``kept_without``:
    documents kept if the rule were left out. The ledger is reduced to its distinct masks first, at most 2^rules rows.
    """
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("mask")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rules])
    each = masks.select("mask", "n", F.explode(rules).alias("r"))
    mask, bit = F.col("mask"), F.col("r.bit")
    hit, rest = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.bitwise_not(bit)) == 0

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        count(hit).alias("failed"), count(hit & rest).alias("alone"), count(rest).alias("kept_without"))


def drift(rows: DataFrame) -> DataFrame:
    """Rules that any, and rules that every document fails, as bit masks."""
    return rows.agg(F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"))
