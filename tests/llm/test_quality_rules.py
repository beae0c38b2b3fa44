from __future__ import annotations

import re
from collections import Counter

from furrow.llm import quality_rules as Q

from .conftest import ODD, frame


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_shouted": text.count("!!")}


def bits(m):
    fails = [
        m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], 10 * m["n_symbols"] > 3 * m["n_words"],
        2 * m["n_dup_lines"] > m["n_lines"], m["word_chars"] < 2 * m["n_words"], m["word_chars"] > 20 * m["n_words"],
        m["n_words"] > 1_000_000, 2 * m["n_shouted"] > m["n_words"]]
    return sum(1 << i for i, f in enumerate(fails) if f)


TEXTS = [
    "a b c a b c", "a a a a", "x y z " * 40, "one two three\none two three\n\n \t\nfour", "A!! B!! C!!!!", "# * $ % & | < >",
    "a\x0bb\x0cc\rd\te", " ".join(str(k) for k in range(80)), " ".join("ab" * 30 for _ in range(60)), "é ü " * 60 + "q",
]


def test_measurements_and_bits(spark, skewed):
    texts = TEXTS + [r["text"] for r in skewed.collect()]
    got = {r["doc_id"]: r.asDict() for r in Q.ledger(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        want = plain(text)
        assert got[k] == want | {"doc_id": k, "failed": bits(want)}


def test_policies_and_ablation(spark, skewed):
    texts = TEXTS + [r["text"] for r in skewed.collect()]
    rows = Q.ledger(frame(spark, texts))
    masks = [bits(plain(t)) for t in texts]
    for policy in Q.POLICIES.values():
        assert rows.filter(Q.passes(policy)).count() == sum(not m & policy.mask for m in masks)
        for r in Q.ablation(rows, policy).collect():
            bit = 1 << Q.RULES.index(r["rule"])
            own = [m & policy.mask for m in masks]
            assert (r["failed"], r["alone"], r["kept_without"]) == (
                sum(bool(m & bit) for m in own), sum(m == bit for m in own), sum(not m & ~bit for m in own))
    low, high = masks[0], 0
    for m in masks:
        low, high = low & m, high | m
    assert tuple(Q.drift(rows).first()) == (high, low)
    assert tuple(Q._rules()) == Q.RULES


def test_odd_rows(odd, none):
    rows = sorted(((repr(r["doc_id"]), r["n_words"], r["failed"]) for r in Q.ledger(odd).collect()))
    assert rows == sorted((repr(d), plain(t)["n_words"], bits(plain(t))) for d, t in ODD)
    assert Q.ledger(none).count() == 0 and Q.ablation(Q.ledger(none), Q.CURRENT).count() == 0
