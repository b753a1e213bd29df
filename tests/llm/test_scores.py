"""Language-model scores, near-copy recall and mixing against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import lm_scoring, minhash_dedup, mixing
from graphloom.llm.common import mix


def _tokens(text):
    return [w.lower() if w.isascii() else w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def _slow_scores(train, asked):
    """(n_known, base, score) of each asked text: interpolated modified Kneser-Ney of order 2 with dictionaries."""
    pairs = Counter(p for t in train for p in zip(["<s>", *_tokens(t)], _tokens(t), strict=False))
    words = Counter(w for t in train for w in _tokens(t))
    follows = Counter(w for _, w in pairs)
    d2, d1 = (lm_scoring.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for c in (pairs, follows))
    less = lambda n, d: d[min(n, 3) - 1] if n else 0.0
    total, back = defaultdict(int), defaultdict(float)
    for (h, _), n in pairs.items():
        total[h] += n
        back[h] += less(n, d2)
    types = len(pairs)
    rest = sum(less(n, d1) for n in follows.values()) / types
    n_all = sum(words.values())
    out = []
    for t in asked:
        known = base = score = 0.0
        for h, w in zip(["<s>", *_tokens(t)], _tokens(t), strict=False):
            c = words[w]
            known += c > 0
            base += math.log10((c + 0.5) / (n_all + 0.5 * (len(words) + 1)))
            low = (follows[w] - less(follows[w], d1)) / types + rest / (len(words) + 1)
            score += math.log10((pairs[h, w] - less(pairs[h, w], d2) + back[h] * low) / total[h] if total[h] else low)
        out.append((known, base, score))
    return out


def test_scores_equal_a_dictionary_version(spark):
    r = random.Random(11)
    words = ["the", "The", "a", "é", "harbour", "MARKET", "x1", *(f"w{i}" for i in range(40))]
    text = lambda: " ".join(r.choice(words[: r.choice([4, 47])]) + r.choice(["", "", "\t", "\n "]) for _ in range(r.randint(1, 40)))
    rows = [(i, text()) for i in range(120)] + [(120, None), (121, ""), (122, " \n"), (5, "the end"), (None, "the end"), (123, "word " * 3000)]
    docs = spark.createDataFrame([(*x, 1, 1.0) for x in rows], "doc_id long, text string, id int, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    out = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 1]
    train = [t for i, t in rows if (i, t) not in out]
    assert 1 <= lm_scoring.train(docs.filter(~held)).shards <= lm_scoring.MOST_SHARDS  # a table in memory doesn't know its size
    model = lm_scoring.train(docs.filter(~held), shards=3)
    got = lm_scoring.score(docs, model, held_out=held).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for (i, t), (known, base, score) in zip(rows, _slow_scores(train, [t for _, t in rows]), strict=True):
        want[i].append((len(_tokens(t)), known, (i, t) in out, pytest.approx(base), pytest.approx(score)))
    for x in got:
        assert (x["n_tokens"], x["n_known"], x["held_out"], x["base_score"], x["score"]) in want[x["id"]]
        assert x["train_tokens"] == sum(len(_tokens(t)) for t in train)
    none = lm_scoring.train(docs.limit(0))
    assert all(x["score"] == 0 and x["n_known"] == 0 for x in lm_scoring.score(docs, none).collect()) and lm_scoring.score(docs.limit(0), model).count() == 0


def test_links_at_the_threshold_share_a_bucket():
    """Recall of candidates on small and large sets, whose bins are not independent: none missed of 3,000 at the least similarity."""
    rng = np.random.default_rng(12)
    for percent in (85, 80):
        rows, missed, pairs = minhash_dedup.band_rows(percent), 0, 0
        for size in (7, 9, 14, 40, 120, 600):
            for _ in range(250):
                least = -(-percent * size // 100)
                both = mix(rng.integers(1, 1 << 62, size).astype(np.uint64))
                a, b = both, both[:least]
                x, y = (minhash_dedup.buckets(minhash_dedup.signature(np.unique(s))[None, :], rows)[0] for s in (a, b))
                missed, pairs = missed + (not (x == y).any()), pairs + 1
        assert pairs == 1500 and missed == 0
    assert minhash_dedup.band_rows(85) == 7 and minhash_dedup.band_rows(80) == 6


def test_near_copies_without_ids_or_with_equal_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a + " end"), (None, a), (None, b), (None, c), (7, b), (7, c), (None, "one two three four"), (None, None), (9, ""), (10, " ".join(f"long{i}" for i in range(30_000)))]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, bucket int")
    got = Counter((x["id"], x["n_shingles"], x["component_id"], x["kept"]) for x in minhash_dedup.find_near(docs, words=3, percent=85).collect())
    assert got == Counter([(5, 39, 5, True), (None, 38, 5, False), (None, 38, 7, False), (None, 38, 7, False), (7, 38, 7, True), (7, 38, 7, True), (None, 2, None, True), (None, 0, None, True), (9, 0, 9, True), (10, 29_998, 10, True)])
    assert minhash_dedup.find_near(docs.limit(0)).count() == 0


def test_pareto_order_takes_the_least_ranks(spark):
    """Within a source, documents are taken by rising rank (odds of the draw over odds of inclusion) until the target, to a histogram's precision."""
    r = random.Random(13)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "b", "c", None])) for i in range(1500)]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, source string, copies int")
    got = mixing.mix(docs, (3, 1, 2)).collect()
    for source in ("a", "b", "c", None):
        mine = [x for x in got if x["source"] == source]
        expected = mine[0]["target"] / mine[0]["source_size"]
        sure, p = math.floor(min(2.0, expected)), min(2.0, expected) % 1
        assert all(x["copies"] in (sure, sure + 1) for x in mine)
        if 1e-6 < p:
            rank = lambda x: (x["u"] / (1 - x["u"])) / (p / (1 - p))  # noqa: B023, E731
            more = [rank(x) for x in mine if x["copies"] > sure]
            assert max(more) <= min(rank(x) for x in mine if x["copies"] == sure)
        assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 31  # the crossing document goes to the nearer side
    assert mixing.mix(docs.limit(0), (3, 1, 2)).count() == 0
