"""Quality classifier: interpolated modified Kneser-Ney n-gram models of trusted text, by language, thresholded by quantiles of each language.

The n-grams are of ORDER bytes (case kept), so that symbols stuck to words, capitals and broken layout all cost. Trained on all trusted rows, whole, in the half of all ids
that a keyed hash gives to training; the thresholds come from all trusted rows of the other half.

Sharded count joins. Tasks count n-grams of their training texts, and counts are summed by (language, n-gram) over the cluster. A task per language turns
its counts (one per distinct n-gram) into sorted hash arrays of discounted counts and back-off weights of all orders, cut into SHARDS by the highest bits of the hash and
written to the shared folder. Tasks that hold documents sort the hashes of their distinct n-grams, and join them shard by shard with those arrays, mapped
into memory: no counts pass the driver, and texts move only to meet trusted ids that are too many to broadcast.

A language's model is mixed with the pooled one by how much text it was trained on, n / (n + MIXED) against the rest, so that few trusted rows lean on
the model of all, alike at every size. The score is bits per byte, drawn to the language's median as if PRIOR more bytes had it, since few bytes tell little. A
document stays if its score is at most the language's QUANTILE of trusted documents outside training, times MARGIN; that of few documents is raised towards
the spread of all.

Defined results: null or empty text scores the language's median and stays; a null language is judged by the pooled model; a language (or null) without
trusted documents outside training is judged by the pooled model and the quantile of all of them under it; no labels at all: every document stays; repeated rows are
judged alike (of rows that share an id, the one of least text trains); further columns are ignored (judge) or kept (drop_bad).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrays import find, get_array, put_array
from graphloom.llm.common import drop_rows, fresh_path, lean, mix, quoted, settle, short_batches, slices, small, utf8

#: Shards are cut by the highest SHARD_BITS bits of the hash.
ORDER, SHARD_BITS = 4, 4
SHARDS = 1 << SHARD_BITS
MIXED = 20_000
PRIOR, QUANTILE, MARGIN = 80, 0.99, 1.05
POOLED = "all"
_BLOCK = 1 << 19
#: N-grams that a task holds before it counts them.
_HELD = 1 << 23


def codes(text: bytes) -> np.ndarray:
    """The n-grams of a text, each byte with the ORDER - 1 before it; line ends stand around the text."""
    a = np.frombuffer(b"\n" * (ORDER - 1) + text + b"\n", np.uint8).astype(np.uint32)
    x = np.zeros(len(text) + 1, np.uint32)
    for i in range(ORDER):
        x = (x << np.uint32(8)) | a[i : i + len(x)]
    return x


def _discounts(n: np.ndarray) -> np.ndarray:
    n1, n2, n3, n4 = (int((n == k).sum()) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *(min(max(x, 0.05), k) for x, k in zip((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), (0.95, 1.9, 2.85), strict=True))])


def _key(kind: int, grams: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams; kind: the order, plus 8 for contexts. Distinct inputs have distinct keys."""
    return mix(grams.astype(np.uint64) | np.uint64(kind << 40))


def build(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shards of sorted keys with values: discounted counts over totals of n-grams of all orders, and back-off weights of contexts.
    Orders below the highest count the distinct bytes before an n-gram."""
    order = np.argsort(grams)
    u, n = grams[order].astype(np.uint32), counts[order].astype(np.int64)
    keys, values = [], []
    for k in range(ORDER, 0, -1):
        d = _discounts(n)
        contexts, at = np.unique(u >> np.uint32(8), return_inverse=True)
        less = d[np.minimum(n, 3)]
        total, back = np.bincount(at, n), np.bincount(at, less)
        keys += [_key(k, u), _key(k + 8, contexts)]
        values += [(n - less) / total[at], back / total]
        u, n = np.unique(u & np.uint32((1 << (8 * (k - 1))) - 1) if k > 1 else u[:0], return_counts=True)
    every, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(every)
    every, value = every[order], value[order]
    cuts = _cuts(every)
    return [(every[a:b], value[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Where the shards of sorted keys begin, and the end."""
    return np.concatenate((np.searchsorted(keys, np.arange(SHARDS, dtype=np.uint64) << np.uint64(64 - SHARD_BITS)), [len(keys)]))


def _join(table: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray, cuts: np.ndarray, missing: float) -> np.ndarray:
    """Values of sorted keys, shard by shard."""
    out = np.full(len(keys), missing)
    for (k, v), a, b in zip(table, cuts[:-1], cuts[1:], strict=True):
        if len(k) and b > a:
            at, hit = find(k, keys[a:b])
            out[a:b][hit] = v[at[hit]]
    return out


def probabilities(tables: list[list[tuple[np.ndarray, np.ndarray]]], grams: np.ndarray) -> list[np.ndarray]:
    """For each model, the probability of each n-gram's last byte. Equal n-grams are joined once."""
    u, where = np.unique(grams, return_inverse=True)
    out = [np.full(len(u), 1 / 257) for _ in tables]
    for k in range(1, ORDER + 1):
        found, at = np.unique(u & np.uint32((1 << (8 * k)) - 1), return_inverse=True)
        contexts, c_at = np.unique(found >> np.uint32(8), return_inverse=True)
        asked = []
        for kind, x in ((k, found), (k + 8, contexts)):
            keys = _key(kind, x)
            order = np.argsort(keys)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            asked.append((keys[order], _cuts(keys[order]), place))
        for i, table in enumerate(tables):
            high, back = (_join(table, keys, cuts, missing)[place] for (keys, cuts, place), missing in zip(asked, (0.0, -1.0), strict=True))
            back = back[c_at]
            out[i] = np.where(back[at] >= 0, high[at] + back[at] * out[i], out[i])
    return [p[where] for p in out]


def trusted_rows(labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """Ids of rows labelled good and not toxic."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col(quoted(label_id)).cast("long").alias("id")).filter("id is not null").distinct()


def _name(lang: str) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(lang.encode())


def _named(batches):
    import pyarrow as pa

    for b in batches:
        langs = b.column("lang").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([_name(x) for x in langs], pa.string())], names=["of", "model"])


def _pieces(text: bytes):
    """codes() of a text, a block at a time; pieces of a very long text overlap by the context."""
    for at in range(0, len(text), _BLOCK):
        part = codes(text[max(0, at - ORDER + 1) : at + _BLOCK])
        yield part[min(at, ORDER - 1) : len(part) - (at + _BLOCK < len(text))]


def train(base: DataFrame, trusted: DataFrame, seed: int) -> tuple[str, DataFrame]:
    """The folder of the models' arrays, and the ids that train: all trusted rows with text in the half of all ids that trains."""
    may = (F.xxhash64(F.lit(seed), "id") % 2 == 0) & (F.octet_length("text") > 0)
    rows = base.filter(may).select("id", "text", "lang")
    ids = settle(rows.select("id").join(small(trusted), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n")), "training")
    once, repeated = ids.filter("n = 1").select("id"), settle(ids.filter("n > 1").select("id"), "repeated")

    def count(batches):
        import pyarrow as pa

        def summed():
            for lang, parts in by.items():
                u, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        by, size = {}, 0
        for b in slices(batches):
            for lang, text in zip(b.column("lang").to_pylist(), utf8(b.column("text")), strict=True):
                for part in _pieces(text):
                    by.setdefault(lang, []).append(part)
                    size += len(part)
                    if size > _HELD:
                        yield from summed()
                        by, size = {}, 0
        yield from summed()

    # of rows that share an id, the one of least text trains; no other text is sorted
    one = rows.join(small(repeated), "id", "left_semi").groupBy("id").agg(F.min(F.struct("text", "lang")).alias("x")).select("x.text", "x.lang")
    texts = rows.join(small(settle(once, "trains-once")), "id", "left_semi").select("text", "lang").unionByName(one)
    each = settle(texts.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    names = settle(each.filter("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    named = names.select("lang").mapInArrow(_named, "of string, model string")
    own = each.join(small(settle(named, "models-of")), F.col("lang") == F.col("of")).select("model", "gram", "n")
    summed = own.unionByName(each.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("model"), "gram", "n"))
    sample = ids.select("id")
    folder = fresh_path(base.sparkSession, "quality-models")

    def write(key, table):
        import pyarrow as pa

        name, n = key[0].as_py(), table.column("n").to_numpy()
        for i, (k, v) in enumerate(build(table.column("gram").to_numpy().astype(np.uint32), n)):
            put_array(folder, f"{name}-{i}.keys", k)
            put_array(folder, f"{name}-{i}.values", v)
        put_array(folder, f"{name}.size", np.array([n.sum()], np.int64))
        return pa.table({"model": [name], "n": [int(n.sum())]})

    # one task per language, over its distinct n-grams: their number is that of the ORDER-byte strings which the language uses, not of its texts
    settle(summed.groupBy("model").applyInArrow(write, "model string, n long"), "models")
    return folder, sample


def _model(folder: str, name: str) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """How many n-grams a model has seen, and its shards."""
    size = get_array(folder, f"{name}.size", np.int64)
    return (int(size[0]) if len(size) else 0), [(get_array(folder, f"{name}-{i}.keys", np.uint64), get_array(folder, f"{name}-{i}.values", np.float64)) for i in range(SHARDS if len(size) else 0)]


def perplexities(base: DataFrame, folder: str) -> DataFrame:
    """id, lang, n_bytes, total_bits (under the language's mixed model), pooled_bits."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            langs, texts = b.column("lang").to_pylist(), utf8(b.column("text"))
            total = np.zeros((2, len(texts)))
            pooled = _model(folder, POOLED)[1]
            for lang in set(langs):
                n, own = _model(folder, _name(lang)) if lang is not None else (0, [])
                weight = n / (n + MIXED)
                held, who, size = [], [], 0

                def flush():
                    if held:
                        p = probabilities([pooled, own] if n else [pooled], np.concatenate(held))  # noqa: B023
                        starts = np.concatenate(([0], np.cumsum([len(x) for x in held])[:-1]))  # noqa: B023
                        p = [weight * p[-1] + (1 - weight) * p[0], p[0]]  # noqa: B023
                        for t, x in zip(total, p, strict=True):  # noqa: B023
                            np.add.at(t, who, np.add.reduceat(-np.log2(x), starts))  # noqa: B023

                for i, t in enumerate(texts):
                    if langs[i] == lang and t:
                        for part in _pieces(t):
                            held.append(part)
                            who.append(i)
                            size += len(part)
                            if size > _BLOCK:
                                flush()
                                held, who, size = [], [], 0
                flush()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array([len(t) for t in texts], pa.int64()), pa.array(total[0]), pa.array(total[1])], names=["id", "lang", "n_bytes", "total_bits", "pooled_bits"])

    return base.mapInArrow(lean(run), "id long, lang string, n_bytes long, total_bits double, pooled_bits double")


def _drawn() -> Column:
    """Bits per byte, drawn to the median."""
    return (F.col("total_bits") + PRIOR * F.col("middle")) / (F.col("n_bytes") + PRIOR)


def limits(known: DataFrame) -> DataFrame:
    """lang, middle, threshold, from held-out trusted rows (lang, n_bytes, total_bits) under the model that judges the language. The quantile
    of few rows is about their largest: it is raised towards the quantile of all rows, each taken relative to its language's median."""
    middle = settle(known.groupBy("lang").agg(F.percentile_approx(F.col("total_bits") / F.col("n_bytes"), 0.5, 10000).alias("middle")), "middles")
    share = known.join(small(middle.withColumnRenamed("lang", "of")), F.col("lang").eqNullSafe(F.col("of"))).withColumn("share", _drawn() / F.col("middle"))
    high = F.percentile_approx("share", QUANTILE, 10000)
    each, every = share.groupBy("lang", "middle").agg(high.alias("high"), F.count(F.lit(1)).alias("n")), share.agg(high.alias("of_all"))
    raised = F.col("high") + F.greatest(F.lit(0.0), F.col("of_all") - F.col("high")) / (1 + F.col("n") * (1 - QUANTILE))
    return each.crossJoin(F.broadcast(every)).select("lang", "middle", (F.col("middle") * raised * MARGIN).alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 11) -> DataFrame:
    """One row per row of docs: id, lang, n_bytes, perplexity (2 to the bits per byte), score, threshold, kept."""
    short_batches(docs.sparkSession)
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(lang_col)).alias("lang"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    trusted = settle(trusted_rows(labels), "trusted")
    folder, sample = train(base, trusted, seed)
    if sample.isEmpty():
        none = F.lit(None).cast("double")
        return base.select("id", "lang", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("perplexity"), none.alias("score"), none.alias("threshold"), F.lit(True).alias("kept"))
    scored = settle(perplexities(base, folder), "perplexities")
    known = settle(scored.join(small(trusted), "id", "left_semi").join(small(sample.select("id")), "id", "left_anti").filter("n_bytes > 0"), "held-out")
    own = settle(limits(known.select("lang", "n_bytes", "total_bits")), "limits").withColumnRenamed("lang", "of").withColumn("found", F.lit(True))
    rest = limits(known.select(F.lit(None).cast("string").alias("lang"), "n_bytes", F.col("pooled_bits").alias("total_bits"))).first()  # one row at most
    values = {x: F.coalesce(x, F.lit(rest[x] if rest else None).cast("double")) for x in ("middle", "threshold")}
    values["total_bits"] = F.when(F.col("found"), F.col("total_bits")).otherwise(F.col("pooled_bits"))
    out = scored.join(small(own), F.col("lang").eqNullSafe(F.col("of")), "left").withColumns(values).withColumn("score", _drawn())
    return out.select("id", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.pow(F.lit(2.0), F.col("total_bits") / F.col("n_bytes"))).alias("perplexity"), "score", "threshold", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)).alias("kept"))


def drop_bad(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that share an id are judged by the best of them; rows without an id stay."""
    verdict = judge(docs, labels, id_col, text_col, lang_col)
    bad = settle(verdict.filter("id is not null").groupBy("id").agg(F.max("kept").alias("kept")).filter("not kept").select("id"), "bad")
    return drop_rows(docs, bad, id_col)
