"""The quality model against a dictionary version, and the pipeline's stages against brute force."""

import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality

NOUNS = "river stone garden winter letter harbour market engine bridge forest teacher window journey silver candle".split()
VERBS = "carries follows remembers crosses finds leaves paints opens measures keeps".split()


def _prose(r, n):
    return " ".join(f"The {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} of the {r.choice(NOUNS)}." for _ in range(n))


def _junk(r, n):
    return "".join(r.choice("#@$%^&*0123456789~|<>{}[]QXZ") for _ in range(n))


def _slow_bits(texts, asked):
    """-log2 p of each byte of asked: interpolated modified Kneser-Ney with dictionaries."""
    order = quality.ORDER

    def grams(t):
        t = b"\n" * (order - 1) + t + b"\n"
        return [t[i : i + order] for i in range(len(t) - order + 1)]

    level, tables = Counter(g for t in texts for g in grams(t)), {}
    for k in range(order, 0, -1):
        n = [sum(v == x for v in level.values()) for x in (1, 2, 3, 4)]
        d = [0, 0.5, 1.0, 1.5]
        if all(n[:3]):
            y = n[0] / (n[0] + 2 * n[1])
            d = [0, *(min(max(x, 0.05), most) for x, most in ((1 - 2 * y * n[1] / n[0], 0.95), (2 - 3 * y * n[2] / n[1], 1.9), (3 - 4 * y * n[3] / n[2], 2.85)))]
        total, back = defaultdict(int), defaultdict(float)
        for g, c in level.items():
            total[g[:-1]] += c
            back[g[:-1]] += d[min(c, 3)]
        tables[k] = level, total, back, d
        level = Counter({s: len({g[0] for g in level if g[1:] == s}) for s in {g[1:] for g in level}}) if k > 1 else None
    out = []
    for g in grams(asked):
        p = 1 / 257
        for k in range(1, order + 1):
            level, total, back, d = tables[k]
            x = g[order - k :]
            if x[:-1] in total:
                c = level.get(x, 0)
                p = ((c - d[min(c, 3)]) + back[x[:-1]] * p) / total[x[:-1]]
        out.append(-math.log2(p))
    return out


def test_bits_equal_a_dictionary_version():
    r = random.Random(1)
    texts = [_prose(r, 2).encode() for _ in range(8)] + ["é ß".encode(), b"x"]
    grams, counts = np.unique(np.concatenate([quality.codes(t) for t in texts]), return_counts=True)
    model = quality.build(grams, counts)
    for asked in (_prose(r, 1).encode(), _junk(r, 40).encode(), b"", "日本".encode()):
        got = quality.probabilities([model, model[:1] + [(np.empty(0, np.uint64), np.empty(0))] * (quality.SHARDS - 1)], quality.codes(asked))
        assert (-np.log2(got[0])).tolist() == pytest.approx(_slow_bits(texts, asked)) and len(got[1]) == len(got[0])


def _corpus(spark, folder):
    r, rows, labels = random.Random(2), [], []
    for i in range(300):
        rows.append((i, _prose(r, 8), ("en", "de", None)[i % 3], ("a", "b", "c", None)[i % 4]))
        if i % 3:
            labels.append((i, 1, 0))
    for i in range(300, 320):
        rows.append((i, _junk(r, 400), "en", "a"))
        labels.append((i, 0, 0))
    rows += [(400 + i, rows[i][1], "en", "b") for i in range(20)]  # exact copies
    rows += [(500 + i, rows[i + 30][1] + " " + _prose(r, 1), "en", "c") for i in range(20)]  # near copies
    rows += [(600, None, "en", "a"), (601, "", None, None), (602, "a few words", "en", "a"), (603, "a few words", "en", "a"), (604, _prose(r, 4000), "de", "a")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {x[0]: x[1] for x in rows}


def test_stages(spark, tmp_path):
    text, folder = _corpus(spark, tmp_path), f"file://{tmp_path}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]

    good = stages[0](spark, docs, folder)
    kept = {x["doc_id"] for x in good.collect()}
    assert good.columns == docs.columns and not kept & set(range(300, 320)) and {600, 601} <= kept
    assert len(kept & set(range(300))) >= 0.97 * 300
    again = quality.judge(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert {x["id"] for x in again if x["kept"]} == kept

    once = stages[1](spark, good, folder)
    largest = {}
    for i in sorted(kept):
        largest[text[i] or ""] = i
    assert once.columns == docs.columns and sorted(x["doc_id"] for x in once.collect()) == sorted(largest.values())

    near = stages[2](spark, once, folder)
    sets = {}
    for i in largest.values():
        w = (text[i] or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if v in (x, y) else v for i, v in root.items()}
    left = {i for i in sets if root[i] == i}
    assert len(left) < len(sets) and near.columns == docs.columns
    assert sorted(x["doc_id"] for x in near.collect()) == sorted(left)

    mixed = stages[3](spark, near, folder)
    times = Counter(x["doc_id"] for x in mixed.collect())
    words = {i: len((text[i] or "").split()) for i in left}
    assert mixed.columns == docs.columns and set(times) <= left and max(times.values()) <= 2
    longest = max(words.values())
    assert abs(sum(n * words[i] for i, n in times.items()) - 1.5 * sum(words.values())) <= 4 * longest

    coded = stages[4](spark, mixed, folder).collect()
    assert Counter(x["doc_id"] for x in coded) == times and all(x["lossless"] and x["n_tokens"] == len(x["token_ids"]) for x in coded)


def test_quality_without_labels_or_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words", "en", 3), (1, "some words", "en", 4), (None, None, None, None)], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(None, 1, 0), (9, 1, None), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(str, quality.drop_bad(docs, labels).collect())) == sorted(map(str, docs.collect()))
    assert quality.drop_bad(docs.limit(0), labels).count() == 0 and quality.drop_bad(docs, labels.limit(0)).count() == 3


def _letters(r, letters, n):
    words = ["".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(60)]
    return lambda: " ".join(r.choice(words) for _ in range(n))


def test_small_languages_are_judged_by_their_own_trusted_rows(spark):
    r = random.Random(3)
    small = _letters(r, "aeioukptzžšč", 60)
    rows = [(i, _prose(r, 8), "en") for i in range(1500)] + [(2000 + i, small(), ("xx", None)[i % 2]) for i in range(160)] + [(3000 + i, _junk(r, 400), "xx") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1500)] + [(2000 + i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    kept = {x["id"] for x in quality.judge(docs, labels).collect() if x["kept"]}
    assert len(kept & set(range(2000, 2160))) >= 155 and len(kept & set(range(1500))) >= 1470 and not kept & set(range(3000, 3010))


def test_stages_keep_clashing_and_dotted_columns(spark, tmp_path):
    """Extra columns named as the stages' own, in any case, and with dots; nulls, equal rows and an empty table."""
    text, folder = _corpus(spark, tmp_path), f"file://{tmp_path}"
    names = ["_id", "_sha", "_STAY", "_draw", "id", "kept", "a.b", "_copies", "hash", "c"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 40 or doc_id > 590")
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, folder)
            assert out.columns == docs.columns and out.filter("`a.b` <> 6").count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, rows, folder).count() == rows.count()


def test_all_trusted_rows_of_the_training_half_are_counted(spark):
    from pyspark.sql import functions as F

    texts = {i: ("word " * 5000 if i % 100 == 7 else f"some words of {i % 13} and {i}") for i in range(1800)}
    base = spark.createDataFrame([(i, "en" if i % 3 else None, t) for i, t in texts.items()], "id long, lang string, text string")
    trusted = spark.range(0, 1800, 1).filter("id % 10 <> 3")
    folder, sample = quality.train(base, trusted, 11)
    half = {r[0] for r in trusted.filter(F.xxhash64(F.lit(11), "id") % 2 == 0).collect()}
    assert {r["id"] for r in sample.collect()} == half and any(i % 100 == 7 for i in half)
    assert quality._model(folder, quality.POOLED)[0] == sum(len(texts[i]) + 1 for i in half)
    assert quality._model(folder, quality._name("en"))[0] == sum(len(texts[i]) + 1 for i in half if i % 3)
