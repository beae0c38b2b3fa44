from __future__ import annotations

import random

import numpy as np

from furrow.llm import queries, shinglegroups
from furrow.session import materialise

from .conftest import ODD, frame, union_find


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset()


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def near_pairs(texts, least=0.8):
    """All pairs of different shingle sets of that similarity, by brute force over shared shingles."""
    sets = sorted({plain(t) for t in texts}, key=lambda s: sorted(s))
    holds = {}
    for k, s in enumerate(sets):
        for x in s:
            holds.setdefault(x, []).append(k)
    pairs = {(a, b) for own in holds.values() for n, a in enumerate(own) for b in own[n + 1:]}
    return sets, [(a, b) for a, b in pairs if alike(sets[a], sets[b]) >= least]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


def test_sketches_reach_the_similarity():
    """Pairs at 0.8 to 0.85 meet in a bucket with the planned probability, and the fingerprint lets them pass."""
    rng, met, far, total = random.Random(1), 0, 0, 0
    bits, tables = shinglegroups.plan(200_000)
    while total < 150:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 600))]
        other = edited(rng, words, round(len(words) * 0.021))
        if not 0.8 <= alike(plain(" ".join(words)), plain(other)) < 0.85:
            continue
        a, b = (shinglegroups._sketch(t.encode(), bits, tables, 5) for t in (" ".join(words), other))
        total += 1
        met += (np.bitwise_count(a[1:] ^ b[1:]) <= 2).any()
        far += int(a[0] ^ b[0]).bit_count() > shinglegroups.FAR if a[0] >= 0 and b[0] >= 0 else 0
    assert met / total >= 0.9 and far / total < 0.02


def test_bucket_pairs(monkeypatch):
    monkeypatch.setattr(shinglegroups, "BLOCK", 70)
    rng = np.random.default_rng(3)
    for sizes in ([1, 2, 5, 1, 64, 30], [65, 200, 3], [500]):
        run, fp = [], []
        for k, n in enumerate(sizes):
            centres = rng.integers(-2**62, 2**62, 4)
            while min(np.bitwise_count(a ^ b) for a in centres for b in centres if a != b) < 24:  # no pairs by chance
                centres = rng.integers(-2**62, 2**62, 4)
            own = np.unique(centres[rng.integers(0, 4, n)] ^ (np.int64(1) << rng.integers(0, 62, n)))
            run += [k] * len(own)
            fp += own.tolist()
        run, fp = np.array(run), np.array(fp)
        pairs = shinglegroups.bucket_pairs(run, fp)
        distance = lambda a, b: int(np.bitwise_count(np.int64(a) ^ np.int64(b)))
        assert all(a < b and distance(a, b) <= shinglegroups.FAR for a, b in pairs.tolist())
        for k in range(len(sizes)):
            own = fp[run == k].tolist()
            whole = [(a, b) for n, a in enumerate(own) for b in own[n + 1:] if distance(a, b) <= shinglegroups.FAR]
            assert union_find([p for p in pairs.tolist() if p[1] in own], own + pairs.ravel().tolist()).keys() >= set(own)
            got = union_find([tuple(p) for p in pairs.tolist() if p[0] in own and p[1] in own], own)
            assert got == union_find(whole, own)


def check(rows, kept, recall):
    """One row of each found group stays; no group joins texts that no chain of near pairs joins."""
    sets, links = near_pairs([t for _, t in rows])
    number = {s: k for k, s in enumerate(sets)}
    want = union_find(links, range(len(sets)))
    left = {number[plain(t)] for _, t in kept}
    assert {want[k] for k in left} == set(want.values())  # every true group keeps a document
    groups = len(set(want.values()))
    dropped, should = len(sets) - len(left), len(sets) - groups
    assert len(kept) >= groups and dropped <= should
    assert dropped >= recall * should
    return should


def test_documents_of_the_test_tables(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = [(r["doc_id"], r["text"]) for r in shinglegroups.keep_one(docs).collect()]
    assert check(rows, kept, 0.9) > 3


def test_near_copies_and_odd_rows(spark, odd, none, skewed):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(60, 300))]
        texts += [" ".join(words), *(edited(rng, words, rng.randint(0, 4)) for _ in range(rng.choice([0, 1, 6])))]
    rows = list(enumerate(texts))
    kept = [(r["doc_id"], r["text"]) for r in shinglegroups.keep_one(frame(spark, rows).repartition(5)).collect()]
    assert check(rows, kept, 0.9) > 60
    rows = [(r["doc_id"], r["text"]) for r in skewed.collect()]
    check(rows, [(r["doc_id"], r["text"]) for r in shinglegroups.keep_one(skewed).collect()], 0.9)
    got = shinglegroups.keep_one(odd)
    assert got.columns == odd.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(kept) == len({plain(t) for _, t in ODD}) and (5, "one two three four five six") in kept
    assert (1, None) in kept and shinglegroups.keep_one(none).count() == 0


def test_no_near_pair_of_a_bucket_is_left_out(monkeypatch):
    """A member near two that are not near each other keeps both pairs; in a large bucket the second pass finds the other."""
    one, two = 0, (1 << 32) - 1
    both = (1 << 16) - 1  # 16 bits from either
    fp = np.array([one, both, two])
    assert shinglegroups.bucket_pairs(np.zeros(3, int), fp).tolist() == [[one, both], [both, two]]
    assert shinglegroups.bucket_pairs(np.zeros(3, int), np.array([0, 1, 3])).tolist() == [[0, 1], [0, 3], [1, 3]]
    monkeypatch.setattr(shinglegroups, "BLOCK", 70)
    rng = np.random.default_rng(5)
    fp = np.sort(rng.integers(0, 1 << 50, 200))
    root = rng.integers(0, 3, 200)
    want = {(a, b) for n, a in enumerate(range(200)) for b in range(n + 1, 200)
            if root[a] != root[b] and int(fp[a] ^ fp[b]).bit_count() <= shinglegroups.FAR}
    got = [tuple(p) for part in shinglegroups.other_pairs(fp, np.arange(200), root) for p in part.tolist()]
    assert len(got) == len(set(got)) > 10 and set(got) == want


def test_a_chain_of_near_texts_is_one_group(spark, monkeypatch):
    """Neighbours are alike and their group's first text is not like the rest: the pairs themselves are verified."""
    rng, rows = random.Random(11), []
    for _ in range(12):
        words = [f"w{rng.randrange(9000)}" for _ in range(400)]
        for step in range(12):
            rows.append((len(rows), " ".join(words)))
            for _ in range(4):
                words[rng.randrange(400)] = f"x{rng.randrange(10**9)}"
    rng.shuffle(rows)
    sets, links = near_pairs([t for _, t in rows])
    number = {s: k for k, s in enumerate(sets)}
    want = union_find(links, range(len(sets)))
    kept = shinglegroups.keep_one(frame(spark, rows)).collect()
    assert len(kept) == len(set(want.values())) == 12
    assert len({want[number[plain(r["text"])]] for r in kept}) == 12


def clump(n, seed):
    """Different texts around one passage: all are near by fingerprint and few are alike, in many small groups."""
    rng, rows = random.Random(seed), []
    shared = [f"s{k}" for k in range(80)]
    while len(rows) < n:
        own = [f"w{rng.randrange(10**6)}" for _ in range(12)]
        for _ in range(rng.choice([1, 1, 2, 4])):
            rows.append((len(rows), " ".join([*shared, *own, f"x{rng.randrange(10**6)}"])))
            own = own[:-2] + [f"w{rng.randrange(10**6)}" for _ in range(2)]
    rng.shuffle(rows)
    return rows


def joined_by(links, members):
    """The sets of members that the links join."""
    root = union_find([tuple(p) for p in links], members)
    found = {}
    for m in members:
        found.setdefault(root[m], set()).add(m)
    return sorted(map(sorted, found.values()))


def test_a_bucket_gives_no_more_rows_than_members(monkeypatch):
    """A forest joins what all near pairs of a bucket join, also with roots that are joined before and runs of other sizes."""
    monkeypatch.setattr(shinglegroups, "BLOCK", 70)
    rng = np.random.default_rng(8)
    for sizes, names in (([300], 300), ([30, 1, 64], 95), ([65, 200, 3], 60), ([2], 1), ([500, 40], 540)):
        run = np.repeat(np.arange(len(sizes)), sizes)
        fp = np.concatenate([np.sort(rng.integers(0, 1 << 44, n)) for n in sizes])
        root = rng.integers(0, names, len(run)) * 7 - 50
        whole = [(root[a], root[b]) for a in range(len(run)) for b in range(a)
                 if run[a] == run[b] and int(fp[a] ^ fp[b]).bit_count() <= shinglegroups.FAR]
        links = shinglegroups.forest(run, fp, root)
        members = sorted(set(root.tolist()))
        assert len(links) < len(members) and all(a < b for a, b in links.tolist())
        assert joined_by(links.tolist(), members) == joined_by(whole, members)


def test_cells_verify_every_near_pair(monkeypatch):
    """Links of a cell, of one side or two, join what all its near and similar pairs join."""
    texts = [t.encode() for _, t in clump(150, 3)]
    table = np.stack([shinglegroups._sketch(t, 24, 8, 5) for t in texts])
    fp, sketch = table[:, 0], table[:, 1:]
    near = [(a, b) for b in range(len(texts)) for a in range(b) if int(fp[a] ^ fp[b]).bit_count() <= shinglegroups.FAR
            and (np.bitwise_count(sketch[a] ^ sketch[b]) <= 2).any()]
    good = [p for p in near if shinglegroups.similarity(texts[p[0]], texts[p[1]]) >= 0.8]
    assert len(near) > 5 * len(good) > 0
    for side in (np.zeros(len(texts), int), np.arange(len(texts)) % 2):
        links = shinglegroups.cell_links(fp, sketch, side, texts)
        want = [p for p in good if not side.any() or side[p[0]] != side[p[1]]]
        assert len(links) < len(texts) and set(links) <= set(want)
        assert joined_by(links, range(len(texts))) == joined_by(want, range(len(texts)))


def test_a_clump_makes_rows_in_proportion(spark, monkeypatch):
    """Texts that are near by fingerprint and not alike: rows of links follow the texts, and sides of a cell lose no group."""
    written = {}

    def count(df, name="table"):
        out = materialise(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(shinglegroups, "materialise", count)
    made = []
    for n in (100, 400):
        rows = clump(n, 6)
        docs = frame(spark, rows).coalesce(1)
        monkeypatch.setattr(shinglegroups, "CELL_ROWS", 60 if n == 400 else 1000)
        found = {r["doc_id"]: r["root"] for r in shinglegroups.groups(docs).collect()}
        made.append(max(written[name] for name in ("equal", "met", "members")))
        written.clear()
    assert made[1] < 6 * made[0]
    sets, links = near_pairs([t for _, t in rows])
    number = {s: k for k, s in enumerate(sets)}
    want = union_find(links, range(len(sets)))
    root = {number[plain(t)]: found[d] for d, t in rows}
    assert len(set(want.values())) <= len(set(root.values())) < 1.05 * len(set(want.values())) < 0.8 * len(rows)
    assert len({(want[k], r) for k, r in root.items()}) == len(set(root.values()))  # none joins two true groups
