"""Language-model scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that
workers map into memory.

Tokens are words (A-Z lower-cased) and one end per text; a text starts after a begin mark that is context only. Stages:
1. unigrams: each task sums its own counts, then shards by word hash sum all; words with over 1/HEAVY of a shard's tokens are hot;
2. bigrams: each task sums its own pairs and deals them by context (pairs of a hot context by word, so that no context
   meets in one task); shards write sorted pair hashes with counts, and context totals with the numbers of words seen once, twice, more;
3. continuation counts: shards send how many contexts each word follows, summed by word;
4. scoring: tasks over all texts look their pairs up in the mapped arrays.
The arrays lie in the shared folder, in as many shards as the size of the input asks for; where that folder is no local path, a worker copies a shard to an
unnamed file when it first needs it.
A word never seen gets the share that unigram smoothing leaves for one more word, so probabilities of all known words and "unknown" sum to 1.

Defined results: null text is an empty text (one token: its end); null ids are training rows; repeated rows count each time; with no
training rows every probability is 1 (no known word); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrays import find, get_array, put_array
from graphloom.llm.common import fresh_path, mix, quoted, settle, short_batches, slices, text_bytes, utf8, word_hashes

BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A task sums its counts whenever it holds so many tokens.
HELD = 3_000_000
HEAVY = 50
#: Bytes of input to a shard, and the bounds of their number; shards grow beyond.
SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 10 << 20, 8, 20_000
_LONG_COUNT = 255


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * _ODD + w)


# ---------------------------------------------------------------- counting


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    n = np.diff(np.concatenate((first, [len(k)]))) if counts is None else np.add.reduceat(counts[order].astype(np.int64), first) if len(k) else np.empty(0, np.int64)
    return k[first], n


def _tokens(batch) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the texts of a batch, ends included, and how many each text has."""
    h, counts = word_hashes(utf8(batch.column("text")))
    return np.insert(h, np.cumsum(counts), END), counts + 1


def _contexts(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.concatenate(([BEGIN], tokens[:-1])) if len(tokens) else tokens
    out[np.concatenate(([0], np.cumsum(counts)[:-1]))] = BEGIN
    return out


def _dealt(shard: np.ndarray):
    """(shard, places) for each shard that has some."""
    order = np.argsort(shard, kind="stable")
    there, first = np.unique(shard[order], return_index=True)
    for i, a, b in zip(there.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        yield i, order[a:b]


def _rows(rows: list[tuple[int, bytes]]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "data"])


_BLOBS = "shard int, data binary"


def _pack(w: np.ndarray, n: np.ndarray) -> bytes:
    return w.tobytes() + n.astype(np.uint32).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n)


def _unigram_blobs(base: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        held, size = [], 0

        def flush():
            w, n = _summed(np.concatenate(held))
            held.clear()
            return _rows([(i, _pack(w[at], n[at])) for i, at in _dealt((w % np.uint64(shards)).astype(np.int64))])

        for b in slices(batches):
            t, _ = _tokens(b)
            held.append(t)
            size += len(t)
            if size >= HELD:
                yield flush()
                size = 0
        if size:
            yield flush()

    return base.select("text").mapInArrow(run, _BLOBS)


def _by_shard(df: DataFrame, shards: int) -> DataFrame:
    return df.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")


def _grouped(batches):
    """(shard, its blobs) from batches in order of shard."""
    now, blobs = None, []
    for b in batches:
        for s, d in zip(b.column("shard").to_pylist(), b.column("data"), strict=True):
            if s != now:
                if blobs:
                    yield now, blobs
                now, blobs = s, []
            blobs.append(d.as_buffer())
    if blobs:
        yield now, blobs


def _merged(blobs) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(x) for x in blobs]
    return _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _sum_unigrams(blobs: DataFrame, shards: int, folder: str, name: str) -> DataFrame:
    """Write each shard's sorted words and counts; a row of sums: distinct, total, numbers counted 1, 2, 3, 4 times, and the hot words."""

    def run(batches):
        import pyarrow as pa

        for shard, data in _grouped(batches):
            w, n = _merged(data)
            put_array(folder, f"{name}-{shard}.keys", w)
            put_array(folder, f"{name}-{shard}.counts", n.astype(np.uint64))
            total = int(n.sum())
            hot = w[n > max(1, total // HEAVY)].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([len(w)], pa.int64()), pa.array([total], pa.int64()), pa.array([[int((n == k).sum()) for k in (1, 2, 3, 4)]], pa.list_(pa.int64())), pa.array([hot], pa.list_(pa.int64()))], names=["words", "total", "often", "hot"])

    return _by_shard(blobs, shards).mapInArrow(run, "words long, total long, often array<long>, hot array<long>")


def _pair_blobs(base: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    def run(batches):
        held, size = [], 0

        def flush():
            h, w = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            held.clear()
            # in order of context, then roughly of word: equal pairs are neighbours but for rare ties, which the shards sum up
            order = np.argsort((h & np.uint64(0xFFFFFFFFFF000000)) | (w >> np.uint64(40)))
            h, w = h[order], w[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1]))))
            n = np.diff(np.concatenate((first, [len(h)]))).astype(np.uint32)
            h, w = h[first], w[first]
            crowded = find(hot, h)[1]
            shard = (np.where(crowded, w, h) % np.uint64(shards)).astype(np.int64)
            out = []
            for i, at in _dealt(shard):
                hs = h[at]
                start = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
                runs = np.diff(np.concatenate((start, [len(hs)]))).astype(np.uint32)
                out.append((i, np.uint64(len(start)).tobytes() + hs[start].tobytes() + w[at].tobytes() + runs.tobytes() + n[at].tobytes()))
            return _rows(out)

        for b in slices(batches):
            t, c = _tokens(b)
            held.append((_contexts(t, c), t))
            size += len(t)
            if size >= HELD:
                yield flush()
                size = 0
        if size:
            yield flush()

    return base.select("text").mapInArrow(run, _BLOBS)


def _pairs_of(data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int(np.frombuffer(data, np.uint64, 1)[0])
    n = (len(data) - 8 - 12 * k) // 12
    h = np.frombuffer(data, np.uint64, k, 8)
    w = np.frombuffer(data, np.uint64, n, 8 + 8 * k)
    runs = np.frombuffer(data, np.uint32, k, 8 + 8 * k + 8 * n)
    return np.repeat(h, runs), w, np.frombuffer(data, np.uint32, n, 8 + 12 * k + 8 * n)


def _sum_pairs(blobs: DataFrame, shards: int, folder: str, hot: np.ndarray) -> DataFrame:
    """Write each shard's pairs and contexts; rows: how many contexts each word follows, by the word's shard, and (shard -1) the numbers
    of pairs counted 1, 2, 3, 4 times, then for each hot context the total and the numbers of words seen once, twice, more."""

    def run(batches):
        for shard, data in _grouped(batches):
            parts = [_pairs_of(x) for x in data]
            h, w, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
            del parts, data
            order = np.lexsort((w, h))
            h, w, n = h[order], w[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1]))))
            n = np.add.reduceat(n.astype(np.uint64), first)
            h, w = h[first], w[first]
            key = pair_hash(h, w)
            order = np.argsort(key)
            put_array(folder, f"pair-{shard}.keys", key[order])
            put_array(folder, f"pair-{shard}.counts", np.minimum(n[order], _LONG_COUNT).astype(np.uint8))
            big = order[n[order] >= _LONG_COUNT]
            put_array(folder, f"many-{shard}.keys", key[big])
            put_array(folder, f"many-{shard}.counts", n[big].astype(np.uint64))
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            put_array(folder, f"context-{shard}.keys", h[start])
            sums = [np.add.reduceat(n, start).astype(np.uint64), *(np.add.reduceat(seen.astype(np.int64), start).astype(np.uint32) for seen in (n == 1, n == 2, n > 2))]
            for name, x in zip(("total", "n1", "n2", "n3"), sums, strict=True):
                put_array(folder, f"context-{shard}.{name}", x)
            place, there = find(h[start], hot)
            often = np.concatenate(([(n == k).sum() for k in (1, 2, 3, 4)], *(np.where(there, x[place].astype(np.int64), 0) for x in sums))).astype(np.int64)
            words, follows = _summed(w)
            yield _rows([(-1, often.tobytes())] + [(i, _pack(words[at], follows[at])) for i, at in _dealt((words % np.uint64(shards)).astype(np.int64))])

    return _by_shard(blobs, shards).mapInArrow(run, _BLOBS)


def discounts(often) -> tuple[float, float, float]:
    """Of modified Kneser-Ney, from the numbers of items counted 1, 2, 3 and 4 times; where those are lacking, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = (int(x) for x in often)
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k) for x, k in zip(d, (0.95, 1.9, 2.85), strict=True))


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers of the whole corpus."""

    folder: str
    shards: int
    tokens: int
    words: int
    continuations: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float
    hot: np.ndarray
    hot_totals: np.ndarray


def train(texts: DataFrame, text_col: str = "text", shards: int | None = None) -> Model:
    spark: SparkSession = texts.sparkSession
    short_batches(spark)
    folder = fresh_path(spark, "ngrams")
    base = texts.select(F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    shards = shards or min(MOST_SHARDS, max(LEAST_SHARDS, -(-text_bytes(base, "text") // SHARD_BYTES)))
    uni = _sum_unigrams(_unigram_blobs(base, shards), shards, folder, "word").collect()  # one row per shard
    hot = sorted(int(np.int64(x).view(np.uint64)) for r in uni for x in r["hot"])
    # HEAVY per shard at most; the begin mark is a context of every text
    hot = np.unique(np.array([*hot, int(BEGIN)], np.uint64))
    pairs = settle(_sum_pairs(_pair_blobs(base, shards, hot), shards, folder, hot), "follows")
    often = np.zeros(4 + 4 * len(hot), np.int64)
    for r in pairs.filter("shard < 0").toLocalIterator():  # one row per shard
        often += np.frombuffer(r["data"], np.int64)
    cont = _sum_unigrams(pairs.filter("shard >= 0"), shards, folder, "follows").collect()
    met = [sum(r["often"][i] for r in cont) for i in range(4)]
    follows, words = sum(r["total"] for r in cont), sum(r["words"] for r in cont)
    d = discounts(met)
    rest = (d[0] * met[0] + d[1] * met[1] + d[2] * (words - met[0] - met[1])) / follows if follows else 1.0
    return Model(folder, shards, sum(r["total"] for r in uni), sum(r["words"] for r in uni), follows, discounts(often[:4]), d, rest, hot, often[4:].reshape(4, -1))


# ---------------------------------------------------------------- scoring


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts after their discount."""
    return counts - np.where(counts > 2, d[2], np.where(counts == 2, d[1], np.where(counts == 1, d[0], 0.0)))


def _look(m: Model, name: str, kind: str, dtype, shard: np.ndarray, keys: np.ndarray) -> tuple:
    """Values of keys in the arrays of their shards; 0 where they lack."""
    kinds = kind.split(",")
    out = [np.zeros(len(keys), np.int64) for _ in kinds]
    for s, at in _dealt(shard):
        place, there = find(get_array(m.folder, f"{name}-{s}.keys", np.uint64), keys[at])
        if there.any():
            for o, k, t in zip(out, kinds, dtype, strict=True):
                o[at[there]] = get_array(m.folder, f"{name}-{s}.{k}", t)[place[there]]
    return tuple(out)


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


def token_scores(m: Model, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens w after h: how often w is in the training text, and the probability p(w | h)."""
    words, at = _unique(w)
    shard = (words % np.uint64(m.shards)).astype(np.int64)
    (known,) = _look(m, "word", "counts", (np.uint64,), shard, words)
    (follows,) = _look(m, "follows", "counts", (np.uint64,), shard, words)
    low = _less(follows, m.word_discounts) / max(1, m.continuations) + m.word_rest / (m.words + 1)
    hot = m.hot
    contexts, c_at = _unique(h)
    totals = np.array(_look(m, "context", "total,n1,n2,n3", (np.uint64, np.uint32, np.uint32, np.uint32), (contexts % np.uint64(m.shards)).astype(np.int64), contexts))
    place, is_hot = find(hot, contexts)
    totals[:, is_hot] = m.hot_totals[:, place[is_hot]]
    total = np.maximum(totals[0], 1)
    d = m.pair_discounts
    back = np.where(totals[0] > 0, (d[0] * totals[1] + d[1] * totals[2] + d[2] * totals[3]) / total, 1.0)
    keys, first, p_at = np.unique(pair_hash(h, w), return_index=True, return_inverse=True)
    shard = (np.where(find(hot, h[first])[1], w[first], h[first]) % np.uint64(m.shards)).astype(np.int64)
    (n,) = _look(m, "pair", "counts", (np.uint8,), shard, keys)
    if (many := np.flatnonzero(n == _LONG_COUNT)).size:
        n[many] = _look(m, "many", "counts", (np.uint64,), shard[many], keys[many])[0]
    high = _less(n, d)[p_at] / total[c_at]
    return known[at], high + back[c_at] * low[at]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    short_batches(docs.sparkSession)
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            t, counts = _tokens(b)
            known, p = token_scores(model, _contexts(t, counts), t)
            start = np.concatenate(([0], np.cumsum(counts)[:-1]))
            base_p = np.log10((known + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
            cols = [b.column("id"), b.column("held_out"), pa.array(counts, pa.int64()), pa.array(np.add.reduceat((known > 0).astype(np.int64), start)), pa.array(np.full(len(counts), model.tokens)), pa.array(np.add.reduceat(base_p, start)), pa.array(np.add.reduceat(np.log10(p), start))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return base.mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
