"""Buckets that stars don't settle: blocks against brute force."""

import numpy as np

from graphloom.llm import minhash_dedup


def _least(edges, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _alike(x, y, percent):
    return 100 * len(x & y) >= percent * len(x | y)


def test_blocks_join_the_same_components():
    rng = np.random.default_rng(3)
    base = np.arange(1, 101, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 100 - k % 12, replace=False), rng.integers(10**6, 10**9, k % 9 + 1).astype(np.uint64)])) for k in range(40)]
    ids, labels, own = np.arange(40), np.arange(40) // 2, np.arange(40) % 3
    start = [(i, i + 1) for i in range(0, 40, 2)]
    true = [(i, j) for i in range(40) for j in range(i) if _alike(set(sets[i]), set(sets[j]), 85)]
    found = []
    for i in range(3):
        for j in range(i, 3):
            at = np.flatnonzero((own == i) | (own == j))
            found += minhash_dedup.block_links(ids[at], labels[at], own[at], [sets[k] for k in at], 85)
    assert found and {(max(x), min(x)) for x in found} <= set(true)
    assert _least(start + found, range(40)) == _least(start + true, range(40))


def test_variants_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_SETS", 5)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):  # close to one text, and for the most part further from each other
        own = list(words)
        for at in rng.choice(120, k % 5 + 1, replace=False):
            own[at] = f"v{k}-{at}"
        rows.append((k, " ".join(own)))
    met = []
    monkeypatch.setattr(minhash_dedup, "_links_in_blocks", lambda *x, f=minhash_dedup._links_in_blocks: met.append(1) or f(*x))
    got = minhash_dedup.find_near(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(118)} for k, t in rows}
    want = _least([(a, b) for a in sets for b in sets if b < a and _alike(sets[a], sets[b], 85)], list(sets))
    assert {r["id"]: r["component_id"] for r in got} == want
    assert met and 1 < len(set(want.values())) < 60


def test_second_stars_leave_the_large_component_alone(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*words, f"v{k}"])) for k in range(50)]  # close to one another, and far from the rest
    rows += [(100 + k, " ".join([*words[:345], *(f"x{k}-{i}" for i in range(55))])) for k in range(12)]
    pairs = []

    def settle(df, label, f=minhash_dedup.settle):
        out = f(df, label)
        if label == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "settle", settle)
    got = minhash_dedup.find_near(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert {r["id"]: r["component_id"] for r in got} == {k: 0 if k < 50 else k for k, _ in rows}
    # in the second round at most FEW_CENTRES of the large component with the others, and pairs of the others in small buckets
    assert len(pairs) == 2 and pairs[1] <= 12 * 10, pairs
