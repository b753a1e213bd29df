"""Source audit, conversation trie and license scan against plain versions on small cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import conversation_trie, license_rules, license_scan, source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# ---------------------------------------------------------------- source audit


def plain_audit(rows, least, top):
    docs = [((r[1] or ""), (r[2] or ""), TERM.findall((r[3] or "").translate(LOWER))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(w for d in mine for w in set(d[2]))
        kept = sorted((w for w, n in seen.items() if n >= least), key=str.encode)
        count = defaultdict(Counter)
        for _, s, words in mine:
            count[s].update(w for w in words if seen[w] >= least)
        whole = sum(count.values(), Counter())
        share = lambda c: [1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept]  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(count[s]) for s in count}, share(whole)
        for s in p:
            pairs = [(sum(map(f, p[s], p[t])), t) for t in p if t != s]
            terms = [(f(a, b), w) for a, b, w in zip(p[s], q, kept, strict=True) if count[s][w] and a > b]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for i, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, v, i + 1))
    return out


AUDIT = "doc_id long, lang string, source string, text string, term string, `a.b` int"


def audited(spark, rows, least=2, top=3, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], AUDIT)
    got = [tuple(r) for r in source_audit.audit(df, least=least, top=top, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def audit_rows(seed=0, n=160):
    r = np.random.default_rng(seed)
    words = ["The", "of", "é", "Ünd", "x-y", "a1b", "longer" * 5, "longer" * 5 + "s", "zz", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))]
    rows = []
    for i in range(n):
        k = int(r.integers(0, 30))
        text = " ".join(r.choice(words, k, p=None if i % 3 else np.array([9.0] * 9 + [1.0] * 40) / 121))
        rows.append((i, ["en", "de", None, ""][int(r.integers(0, 4))], [f"s{j}" for j in range(6)][int(r.integers(0, 6))] if i % 11 else None, text if i % 13 else None))
    return [*rows, (None, "xx", "only", "lonely words"), (1, "yy", "a", ""), (1, "yy", "b", "!!"), rows[5], rows[5]]


def test_audit_equals_plain(spark):
    for seed in (0, 1):
        rows = audit_rows(seed)
        assert audited(spark, rows) == plain_audit(rows, 2, 3)


def test_audit_bounds_and_collisions(spark, monkeypatch):
    rows = audit_rows(2)
    for name, value in (("HELD", 40), ("PIECE", 50), ("MATRIX", 7), ("PAIRS", 3)):
        monkeypatch.setattr(source_audit, name, value)
    c = source_audit.count_texts([r[3].encode() for r in rows if r[3]], np.zeros(len([r for r in rows if r[3]]), np.int64), [("en", "s")])
    monkeypatch.setattr(source_audit, "hash_slices", lambda d, s, n: (np.asarray(n) % 3).astype(np.uint64))
    weak = source_audit.count_texts([r[3].encode() for r in rows if r[3]], np.zeros(len([r for r in rows if r[3]]), np.int64), [("en", "s")])
    words = lambda c: {c.buf[e - n : e].tobytes(): k for e, n, k in zip(c.ends, c.length, c.count, strict=True)}
    assert words(c) == words(weak) and len(c.ends) > 20
    back = [source_audit._undealt(d) for _, d in source_audit._dealt(weak, 2)]
    assert words(source_audit.merged([*back, weak])) == {w: 2 * n for w, n in words(c).items()}
    long = source_audit._long_text(b" ".join([b"aa bb aa"] * 100), [("en", "s")])
    assert sorted(zip(long.count.tolist(), long.docs.tolist(), strict=True)) == [(100, 1), (200, 1)]


def test_audit_edges(spark):
    assert audited(spark, []) == set()
    rows = [(1, "en", "a", "x" * 3_000_000 + " y" * 400_000), (2, "en", "b", "y z"), (3, "en", "c", None)]
    assert audited(spark, rows, least=1, top=10) == plain_audit(rows, 1, 10)
    assert audited(spark, audit_rows(3), shards=3) == plain_audit(audit_rows(3), 2, 3)


def test_share_is_exact():
    r = np.random.default_rng(1)
    whole = r.integers(1, 9 * 10**15, 500)
    count = (whole * r.random(500)).astype(np.int64)
    assert source_audit.share(count, whole).tolist() == [1 + 10**9 * (int(c) + 2) // int(w) for c, w in zip(count, whole, strict=True)]


# ---------------------------------------------------------------- conversation trie


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - int(np.fmod(c, 100))
        built[c] = tuple(turns.get(first, [])[:h] + mine[h:])
    nodes = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    total = {}
    for k in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[k]) - 1) * len(k[-1][1]) if k else 0
        total[k] = (sum(total[x][0] for x in kids[k]) or 1, saved + sum(total[x][1] for x in kids[k]))
    out = set()
    for k, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(k)))
        out.add((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), *total[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string, conv long, depth string"


def tried(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    got = [tuple(r) for r in conversation_trie.trie(df, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def turn_rows(seed, convs=260):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        if c % 7 == 3:
            continue
        n = int(r.integers(1, 8))
        for t in range(n):
            rows.append((int(c), None if r.random() < 0.03 else t, ["user", "assistant", None, ""][int(r.integers(0, 4))] if r.random() < 0.1 else "user", [None, "", "é" * 3, "a", "bb"][int(r.integers(0, 5))]))
    same = [(t, "user", f"same {t}") for t in range(7)]
    rows += [(c, *x) for c in range(1000, 1060) for x in same[: 3 + c % 4]]  # prefixes of one another
    rows += [(-c, *x) for c in range(90, 130) for x in same]
    return rows + [(None, 0, "user", "x"), rows[0], rows[0]]


def test_trie_equals_plain(spark):
    for seed in (0, 1):
        rows = turn_rows(seed)
        assert tried(spark, rows) == plain_trie(rows)


def test_trie_chunks_and_long_chains(spark):
    long = [(100, t, "user", f"t{t}") for t in range(90)]
    rows = [x for c in range(100, 190) for x in [(c, *y[1:]) for y in long[: c - 99]]] + turn_rows(2, 40)
    assert tried(spark, rows, chunk=7) == plain_trie(rows)


def test_trie_rounds_grow_slowly(spark):
    """A spine of 300 segments, each with one leaf, takes about as many rounds as its length has binary digits."""
    n = 300
    spine = [(i, 2, i - 1 if i else None, 2 if i else None, 2 if i < n - 1 else 0, ((i + 1) ^ (1000 + i)) if i < n - 1 else 0, (2 ^ 1) if i < n - 1 else 0, 1) for i in range(n)]
    leaves = [(1000 + i, 1, i, 2, 0, 0, 0, 0) for i in range(n - 1)]
    segs = spark.createDataFrame(spine + leaves, "conv long, n long, p_conv long, p_n long, kids long, kx long, kn long, own long")
    got, rounds = conversation_trie.peel(segs)
    found = {r["conv"]: (r["leaves"], r["saved"]) for r in got.collect()}
    assert len(found) == 2 * n - 1 and all(found[i] == (n - i, n - i) for i in range(n)) and rounds <= 14


def test_trie_edges(spark):
    assert tried(spark, []) == set()
    assert tried(spark, [(None, 1, "a", "b")]) == set()
    for rows in ([(5, 0, "user", "x")], [(c, 0, "user", "x") for c in range(1, 40)], [(c, t, None, "y" * 2_000_000) for c in (100, 101) for t in range(3)]):
        assert tried(spark, rows) == plain_trie(rows)


def test_trie_fails_on_colliding_keys(spark, monkeypatch):
    class Same:
        def __init__(self, data, digest_size):
            self.data = data

        def digest(self):
            return bytes(8) + hashlib.md5(self.data).digest()[:8]

    df = spark.createDataFrame([(1, 1, 0, 0, 5, 6, 3, 3, True), (2, 1, 0, 0, 5, 6, 4, 3, True)], "conv long, depth long, pa long, pb long, qa long, qb long, lo long, chars long, end boolean").selectExpr("*", "chars as cum")
    convs = spark.createDataFrame([(1, 1), (2, 1)], "conv long, length long")
    with pytest.raises(Exception, match="two sequences of turns have one key"):
        conversation_trie.trie_nodes(df, convs).collect()


# ---------------------------------------------------------------- license scan


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    joined = " " + " ".join(words) + " "
    at = lambda i: joined.count(" ", 0, i) - 1
    found, base = [], []
    for order, (label, priority, _, pattern) in enumerate(license_rules.parsed()):
        p = re.compile("(?<= )(?:" + re.sub(r"<(\d+)>", r"(?:[^ ]+ ){0,\1}", pattern) + ")(?= )")
        found += [(at(m.start()), at(m.end()), priority, order, label) for m in p.finditer(joined)]
    for phrase, label in license_rules.BASE.items():
        parts = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1]
    better = lambda a, b: (b[2] > a[2]) or (b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or (b[:2] == a[:2] and b[3] < a[3])))
    kept = [a for a in found if not any(inside(a, b) and better(a, b) for b in found)]
    labels = sorted({a[4] for a in kept} | {x for _, x in base})
    sure = [max([license_rules.CONFIDENCE[a[2]] for a in kept if a[4] == n] + [0.8 for _, x in base if x == n]) for n in labels]
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(labels), 1 - float(np.prod([1 - x for x in sure]))


NOTICES = [
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the MIT License.", "GNU General Public License, version 3",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "(c) 2020 X. All rights reserved.", "CC-BY cc by CC\tBY", "Alle Rechte vorbehalten", "https://creativecommons.org/licenses/by-sa/4.0/", "SPDX-License-Identifier: MIT", "tous droits réservés",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "GNU Lesser General Public License v2.1", "general public license general public license", "ccby generalpublic license",
]


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, id int, `n.words` string")
    return {r["id"]: tuple(r)[1:] for r in license_scan.digest(license_scan.scan(df)).collect()}


def test_licenses_equal_plain(spark):
    r = np.random.default_rng(0)
    filler = ["und", "mit", "license", "the", "öl", "2", "BY", "cc", "all", "rights", "reserved"]
    texts = [*NOTICES, None, "", "...", "é"] + [" ".join([*r.choice(filler, int(r.integers(0, 9))), *r.choice(NOTICES, int(r.integers(0, 4))), *r.choice(filler, int(r.integers(0, 30)))]) for _ in range(300)]
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        want = plain_scan(t)
        assert got[i][:6] == want[:6], t
        assert got[i][6] == pytest.approx(want[6]) and 0 <= got[i][6] <= 1


def test_license_labels_and_spans(spark):
    df = spark.createDataFrame([(1, "x Licensed under CC BY-NC 4.0. y"), (2, NOTICES[4])], "doc_id long, text string")
    got = {(r["id"], r["label"]): r["words"] for r in license_scan.spans(license_scan.scan(df)).collect()}
    assert got[1, "cc-by-nc-4.0"] == "cc by nc 4 0" and (1, "cc-by") in got and (1, "cc-by-nc") not in got
    assert (2, "gpl-2.0-or-later") in got and got[2, "gpl"] in ("general public license", "this program is free software you can redistribute it and or modify it under the terms")


def test_license_rules_are_whole():
    rules = license_rules.parsed()
    assert len(rules) >= 200 and {r[1] for r in rules} == set(license_rules.CONFIDENCE)
    for label, _, keyword, pattern in rules:
        literal = re.sub(r"\(\?:[^()]*\)\??|<\d+>|\[[^\]]*\]\+?", "\0", pattern)
        alternatives = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"<\d+>|\[([a-z0-9])[^\]]*\]\+?", r"\1", pattern))
        assert keyword in alternatives or any(keyword in p for p in literal.split("\0")), (label, pattern)


def test_license_edges(spark):
    assert scanned(spark, []) == {}
    text = "cc by " * 200_000 + "x" * 1_000_000
    assert scanned(spark, [text, text])[1][:5] == (400_001, 200_000, 0, 399_998, "cc-by")
