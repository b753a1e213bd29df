import hashlib
import random
from collections import Counter

import numpy as np

from graphloom.llm import suffix_dedup as S


def test_repeated_windows_equal_brute_force():
    r = random.Random(4)
    for alphabet, length in ((b"ab", 5), (b"abc\x00\xff", 8), (b"abcdefgh", 4)):
        for _ in range(60):
            base = bytes(r.choice(alphabet) for _ in range(40))
            contexts = []
            for _ in range(r.randint(1, 12)):
                c = bytearray(base[r.randint(0, 10) : r.randint(25, 40)])
                c[r.randrange(len(c))] = r.choice(alphabet)
                contexts.append(bytes(c))
            copies = [r.choice([1, 1, 1, 2]) for _ in contexts]
            seen = Counter()
            for c, n in zip(contexts, copies, strict=True):
                for i in range(len(c) - length + 1):
                    seen[c[i : i + length]] += n
            got = S.repeated_windows(contexts, copies, length)
            for c, hit in zip(contexts, got, strict=True):
                assert hit.tolist() == [seen[c[i : i + length]] >= 2 for i in range(len(c) - length + 1)]


def test_common_prefixes_equal_brute_force():
    r = random.Random(5)
    for _ in range(40):
        s = np.array([r.randint(1, 3) for _ in range(60)] * 2 + [0], np.uint16)
        order = S.suffix_array(s, 20)
        t = s.byteswap().tobytes()
        want = [t[2 * a : 2 * a + 40] == t[2 * b : 2 * b + 40] for a, b in zip(order[:-1], order[1:], strict=True)]
        assert S.long_prefixes(s, order, 20).tolist() == want


def test_anchors_of_equal_windows_are_equal():
    r = random.Random(6)
    shared = bytes(r.randrange(256) for _ in range(300))
    a, b = bytes(r.randrange(256) for _ in range(500)) + shared, shared + bytes(r.randrange(256) for _ in range(700))
    at = {}
    for k, t in ((0, a), (1, b)):
        for h, first, last in S.text_runs(t, 100, 25):
            for x, lo, hi in zip(h.tolist(), first.tolist(), last.tolist(), strict=True):
                for w in range(lo, hi + 1):
                    at.setdefault(t[w : w + 100], set()).add(x)
    assert sum(len(v) == 1 for v in at.values()) == len(at)


def _brute(rows, length):
    texts = [(b or "").encode() for _, b in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((key, len(t), sum(gone), sum(b"\0" + gone[i : i + 1] == b"\0\1" if i == 0 else gone[i - 1 : i + 1] == b"\0\1" for i in range(len(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def test_crowded_anchors_go_through_longer_ones(spark):
    """A passage that all texts share, between others that some share: at every limit of contexts the same as brute force."""
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    common, some = word(33), [word(60) for _ in range(4)]
    rows = [(i, word(r.randint(0, 50)) + (r.choice(some) if i % 3 == 0 else word(9)) + common + (r.choice(some) if i % 4 == 0 else word(30)) + word(r.randint(0, 40))) for i in range(60)]
    rows += [(100, "xy" * 90), (101, None), (102, ""), (103, common), (104, rows[0][1]), (104, rows[0][1]), (None, rows[3][1])]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, id int")
    for most in (1, 3, 1000):
        got = S.remove_repeats(docs, length=40, most_contexts=most).collect()
        assert sorted(str(tuple(x)) for x in got) == _brute(rows, 40)
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_pieces_of_a_long_text_have_the_windows_of_the_whole(monkeypatch):
    r = random.Random(7)
    text = bytes(r.choice(b"abc") for _ in range(900))
    whole = {x: h for hs, a, b in S.text_runs(text, 50, 12) for h, lo, hi in zip(hs.tolist(), a, b, strict=True) for x in range(lo, hi + 1)}
    monkeypatch.setattr(S, "PIECE", 101)
    assert {x: h for hs, a, b in S.text_runs(text, 50, 12) for h, lo, hi in zip(hs.tolist(), a, b, strict=True) for x in range(lo, hi + 1)} == whole and set(whole) == set(range(851))
