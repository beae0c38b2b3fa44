from __future__ import annotations

from collections import defaultdict

import numpy as np

from furrow.llm import linededup

from .conftest import LINE, ODD, frame

BLANK = " \t\n\x0b\f\r"


def plain(rows, min_chars=40, min_docs=5):
    """(doc_id, lines, dropped, text) of every row, by brute force."""
    def key(line):
        line = line.strip(BLANK)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    holders = defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=repr)


def test_skewed_lines(skewed):
    rows = [(r["doc_id"], r["text"]) for r in skewed.collect()]
    result = linededup.dedup_lines(skewed)
    assert got(result) == plain(rows)
    assert sum(r["n_dropped"] for r in result.collect()) >= 100


def test_case_blanks_and_length(spark):
    forty = "É" * 40
    texts = [f"  {LINE.upper()}\t\nown {k}\n{forty}\n{'é' * 39}\r" for k in range(5)] + [f"{LINE}\n{LINE}\nx"]
    rows = list(enumerate(texts))
    assert got(linededup.dedup_lines(frame(spark, texts))) == plain(rows)


def test_odd_rows(odd, none):
    result = linededup.dedup_lines(odd)
    assert got(result) == plain(ODD)
    assert result.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert linededup.dedup_lines(none).count() == 0


def test_insert_and_delete_are_reversible(spark, skewed):
    rows = [(r["doc_id"], r["text"]) for r in skewed.collect()]
    first, second = skewed.filter("doc_id < 100"), skewed.filter("doc_id >= 100")
    index = linededup.LineIndex(spark, shard_keys=50)
    index.insert(first)
    before = sorted(map(tuple, index.counts().collect()))
    index.insert(second)
    index.insert(second)  # known documents add nothing
    assert got(index.apply(skewed)) == plain(rows)
    index.delete(second.select("doc_id"))
    assert sorted(map(tuple, index.counts().collect())) == before
    assert got(index.apply(first)) == plain([r for r in rows if r[0] < 100])
    present = index.probe(index.counts().select("k1", "k2"))
    assert present.filter("NOT maybe").count() == 0
    index.delete(first.select("doc_id"))
    assert index.counts().count() == 0
    index.insert(skewed)
    assert got(index.apply(skewed)) == plain(rows)


def test_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 40_000)
    cuckoo = linededup.CuckooFilter()
    for part in np.array_split(keys[:30_000], 7):
        cuckoo.insert(part)
    cuckoo = linededup.CuckooFilter.read(cuckoo.write())
    assert cuckoo.contains(keys[:30_000]).all()
    assert cuckoo.contains(keys[30_000:]).mean() < 0.01
    cuckoo.delete(keys[:20_000])
    assert cuckoo.contains(keys[20_000:30_000]).all()
    assert cuckoo.contains(keys[:20_000]).mean() < 0.01
    cuckoo.delete(keys[20_000:30_000])
    assert sum(int((t > 0).sum()) for t in cuckoo.tables) == 0
