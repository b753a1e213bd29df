"""Divergence of the sources of a language: how differently they use the terms that the language keeps.

1. Byte-level tokenizer: the UTF-8 buffers of a batch are concatenated, and a table of 256 entries lower-cases the bytes and finds where terms begin and end.
2. xxhash groups the slices; every slice is compared with its group's first, eight bytes at a time, and slices that differ in spite of equal hashes are grouped by their bytes.
3. Each task sums its counts by term and group (language and source) before it deals them out by hash, and again where they meet; a shard of terms drops what its language doesn't keep and writes
   the rest as CSR matrices, a row per term and a column per source.
4. A term that neither of two sources has adds the same amount for every such term; one that only one has adds an amount that depends on its count alone. So a pair's divergence
   is a sum over all terms (one product), a sum over a histogram of counts for each side, and corrections for the terms that both have, which are taken from the rows of the matrices
   by reduceat. All numbers are whole.

A very frequent term is one row of a task's counts however often it occurs; a large source is summed in every task. Shards grow only beyond MOST_SHARDS. The sources of one language must fit a task's
memory, as the result holds all pairs of them. Totals of terms up to 9e15 are exact.

Defined results: null text, language and source count as empty; repeated rows are so many documents; a language without kept terms has pairs of value 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import quoted, settle, short_batches, slices, small, text_bytes, utf8

#: Bytes of text to a shard of terms, and the bounds of their number.
SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 24 << 20, 16, 20_000
#: A task sums its counts whenever it holds so many entries; bytes that are tokenized at once; entries of a matrix written at once.
HELD, PIECE, MATRIX = 1_500_000, 2 << 20, 200_000
#: Pairs of entries that are compared at once.
PAIRS = 500_000
ONE = 1_000_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


# ---------------------------------------------------------------- terms


def boundaries(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer with A-Z lower-cased, and where its terms begin and how long they are."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _TERM[buf], [False])).view(np.int8)))
    return _LOWER[buf], edge[::2], edge[1::2] - edge[::2]


def hash_slices(data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    digest, out = xxhash.xxh3_64_intdigest, np.empty(len(start), np.uint64)
    for at in range(0, len(start), 1 << 18):
        some = slice(at, at + (1 << 18))
        out[some] = np.fromiter((digest(data[a:b]) for a, b in zip(start[some].tolist(), (start[some] + length[some]).tolist(), strict=True)), np.uint64, len(start[some]))
    return out


def _differ(buf: np.ndarray, a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Whether slices at a and b differ."""
    out = la != lb
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    todo, done = np.flatnonzero(~out & (a != b)), 0
    while len(todo):
        mask = _MASK[np.minimum(la[todo] - done, 8)]
        bad = ((eight[a[todo] + done] ^ eight[b[todo] + done]) & mask) != 0
        out[todo[bad]] = True
        done += 8
        todo = todo[~bad & (la[todo] > done)]
    return out


def group_slices(buf: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each slice's group, and each group's first slice. Groups come in order of hash; equal bytes are one group."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    rep = first[group]
    if (odd := _differ(buf, start, start[rep], length, length[rep])).any():
        for g in np.unique(group[odd]).tolist():
            known: dict[bytes, int] = {}
            fresh = []
            for i in np.flatnonzero(group == g).tolist():
                word = buf[start[i] : start[i] + length[i]].tobytes()
                if word not in known:
                    known[word] = g if not known else len(first) + len(fresh)
                    if len(known) > 1:
                        fresh.append(i)
                group[i] = known[word]
            first = np.concatenate((first, np.array(fresh, np.int64)))
        by_hash = np.argsort(hashes[first], kind="stable")
        place = np.empty(len(first), np.int64)
        place[by_hash] = np.arange(len(first))
        group, first = place[group], first[by_hash]
    return group, first


def _gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices one after the other, and where each ends."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return buf[np.arange(total) + np.repeat(start - (ends - length), length)], ends


class Counts:
    """Terms (bytes and ends, in order of hash), and entries (term, group, count, docs) in order of term and group."""

    def __init__(self, groups: list[tuple[str, str]], buf: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None, term: np.ndarray, group: np.ndarray, count: np.ndarray, docs: np.ndarray):
        self.groups, self.buf, self.ends = groups, buf, ends
        self.length = np.diff(np.concatenate(([0], ends)))
        self.hashes = hash_slices(buf.tobytes(), ends - self.length, self.length) if hashes is None else hashes
        self.term, self.group, self.count, self.docs = term, group, count, docs


def _entries(term: np.ndarray, group: np.ndarray, groups: int, count: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of equal term and group summed."""
    key = term * max(1, groups) + group
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    add = lambda x: np.add.reduceat(x[order], first) if len(k) else x
    return k[first] // max(1, groups), k[first] % max(1, groups), add(count), add(docs)


def count_texts(texts: list[bytes], group: np.ndarray, groups: list[tuple[str, str]]) -> Counts:
    """The counts of some texts, each of a group."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = b" ".join(texts)
    buf, start, length = boundaries(np.frombuffer(data, np.uint8))
    hashes = hash_slices(buf.tobytes(), start, length)
    term, first = group_slices(buf, start, length, hashes)
    doc = np.searchsorted(np.cumsum(sizes), start, side="right")
    key, count = np.unique(term * max(1, len(texts)) + doc, return_counts=True)
    t, d = key // max(1, len(texts)), key % max(1, len(texts))
    t, g, count, docs = _entries(t, group[d], len(groups), count.astype(np.int64), np.ones(len(t), np.int64))
    words, ends = _gather(buf, start[first], length[first])
    return Counts(groups, words, ends, hashes[first], t, g, count, docs)


def merged(tables: list[Counts]) -> Counts:
    known: dict[tuple[str, str], int] = {}
    buf = np.concatenate([t.buf for t in tables])
    shift = np.concatenate(([0], np.cumsum([len(t.buf) for t in tables])[:-1]))
    length = np.concatenate([t.length for t in tables])
    start = np.concatenate([t.ends - t.length + s for t, s in zip(tables, shift, strict=True)])
    hashes = np.concatenate([t.hashes for t in tables])
    at, first = group_slices(buf, start, length, hashes)
    before = np.concatenate(([0], np.cumsum([len(t.ends) for t in tables])[:-1]))
    term = np.concatenate([at[t.term + b] for t, b in zip(tables, before, strict=True)])
    group = np.concatenate([np.array([known.setdefault(g, len(known)) for g in t.groups], np.int64)[t.group] for t in tables])
    t, g, count, docs = _entries(term, group, len(known), np.concatenate([t.count for t in tables]), np.concatenate([t.docs for t in tables]))
    words, ends = _gather(buf, start[first], length[first])
    return Counts(list(known), words, ends, hashes[first], t, g, count, docs)


def _long_text(text: bytes, groups: list[tuple[str, str]]) -> Counts:
    """The counts of one text, in pieces that end between terms; a term counts for one document."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and _TERM[text[end]]:
            end += 1
        parts.append(count_texts([text[at:end]], np.zeros(1, np.int64), groups))
        if len(parts) > 1 and sum(len(p.term) for p in parts) > HELD:
            parts = [merged(parts)]
        at = end
    out = merged(parts)
    out.docs = np.minimum(out.docs, 1)
    return out


def _dealt(c: Counts, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, its part of the counts) for each shard that has some."""
    shard = (c.hashes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by = np.argsort(place[c.term], kind="stable")
    term = place[c.term][by]
    if not len(order):
        return
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0)))
    words, ends = _gather(c.buf, (c.ends - c.length)[order], c.length[order])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        x, y = np.searchsorted(term, (a, b))
        lo = int(ends[a - 1]) if a else 0
        e = by[x:y]
        used, group = np.unique(c.group[e], return_inverse=True)
        yield int(shard[order[a]]), pickle.dumps(([c.groups[i] for i in used.tolist()], words[lo : ends[b - 1]].tobytes(), c.length[order][a:b].astype(np.uint32).tobytes(), (term[x:y] - a).astype(np.uint32).tobytes(), group.astype(np.uint32).tobytes(), _short(c.count[e]), _short(c.docs[e])), 5)


def _short(x: np.ndarray) -> tuple[str, bytes]:
    kind = "<u2" if not len(x) or x.max() < 1 << 16 else "<u8"
    return kind, x.astype(kind).tobytes()


def _undealt(data: bytes) -> Counts:
    groups, words, length, term, group, count, docs = pickle.loads(data)
    long_ = lambda x, kind: np.frombuffer(x, kind).astype(np.int64)
    return Counts(groups, np.frombuffer(words, np.uint8), np.cumsum(long_(length, np.uint32)), None, long_(term, np.uint32), long_(group, np.uint32), long_(count[1], count[0]), long_(docs[1], docs[0]))


def _counted(docs: DataFrame, shards: int) -> DataFrame:
    """shard, data: each task's counts."""

    def run(batches):
        import pyarrow as pa

        held: list[Counts] = []

        def flush():
            rows = list(_dealt(merged(held), shards))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "data"])

        for b in slices(batches):
            texts, names = utf8(b.column("text")), list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True))
            known: dict[tuple[str, str], int] = {}
            group = np.array([known.setdefault(x, len(known)) for x in names], np.int64)
            held.append(_long_text(texts[0], list(known)) if len(texts) == 1 and len(texts[0]) > PIECE else count_texts(texts, group, list(known)))
            if sum(len(c.term) for c in held) >= HELD:
                yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "shard int, data binary")


# ---------------------------------------------------------------- matrices


def _matrices(c: Counts, least: int) -> Iterator[tuple]:
    """(lang, rows, sources, totals, matrix) of the kept terms, a language at a time, in rows of about MATRIX entries; terms in order of their bytes."""
    langs = sorted({g[0] for g in c.groups})
    lang_of = np.array([langs.index(g[0]) for g in c.groups], np.int64)[c.group] if len(c.group) else c.group
    for i, lang in enumerate(langs):
        mine = np.flatnonzero(lang_of == i)
        term = c.term[mine]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        keep = np.add.reduceat(c.docs[mine], first) >= least
        size = np.diff(np.concatenate((first, [len(term)])))
        words = {int(t): c.buf[c.ends[t] - c.length[t] : c.ends[t]].tobytes() for t in term[first[keep]]}
        rank = {t: n for n, t in enumerate(sorted(words, key=words.__getitem__))}
        mine = mine[np.repeat(keep, size)]
        if not len(mine):
            continue
        row = np.array([rank[t] for t in c.term[mine].tolist()], np.int64)
        order = np.argsort(row, kind="stable")
        row, group, count = row[order], c.group[mine][order], c.count[mine][order]
        by_rank = sorted(words.values())
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        ends = np.concatenate((first[1:], [len(row)]))
        a = 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(ends, first[a] + MATRIX, side="right")))
            x, y = first[a], ends[b - 1]
            used, col = np.unique(group[x:y], return_inverse=True)
            totals = np.bincount(col, minlength=len(used)) * 0
            np.add.at(totals, col, count[x:y])
            indptr = np.concatenate((first[a:b], [y])) - x
            yield lang, b - a, [c.groups[g][1] for g in used.tolist()], totals.tolist(), pickle.dumps((by_rank[a:b], indptr.astype(np.int64).tobytes(), col.astype(np.int32).tobytes(), _short(count[x:y])), 5)
            a = b


def term_matrices(docs: DataFrame, least: int, shards: int) -> DataFrame:
    """lang, v, sources, totals, matrix: the counts of the kept terms; see _matrices."""

    def run(batches):
        import pyarrow as pa

        def rows(c: Counts | None):
            for m in _matrices(c, least) if c else ():
                cols = [pa.array([m[0]]), pa.array([m[1]], pa.int64()), pa.array([m[2]], pa.list_(pa.string())), pa.array([m[3]], pa.list_(pa.int64())), pa.array([m[4]], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "v", "sources", "totals", "matrix"])

        now, parts, size = None, [], 0
        for b in batches:
            for s, d in zip(b.column("shard").to_pylist(), b.column("data"), strict=True):
                if s != now:
                    if parts:
                        yield from rows(merged(parts))
                    now, parts, size = s, [], 0
                parts.append(_undealt(d.as_buffer()))
                if sum(len(p.term) for p in parts) > size + HELD:
                    parts = [merged(parts)]
                    size = len(parts[0].term)
        if parts:
            yield from rows(merged(parts))

    dealt = _counted(docs, shards).repartition(F.col("shard")).sortWithinPartitions("shard")
    return settle(dealt.mapInArrow(run, "lang string, v long, sources array<string>, totals array<long>, matrix binary"), "matrices")


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * (count + 2) / whole), by long division in three steps of a thousand."""
    q, r = np.divmod(count + 2, whole)
    for _ in range(3):
        q2, r = np.divmod(r * 1000, whole)
        q = q * 1000 + q2
    return q + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def both_have(indptr: np.ndarray, col: np.ndarray, p: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(s, t, sum) for columns s < t of a CSR matrix: what the rows with both add beyond what each would add against a column without them. Entries of a row are in order of column."""
    end = np.repeat(indptr[1:], np.diff(indptr))
    later = end - np.arange(len(col)) - 1  # entries after each in its row
    cut, found = np.cumsum(later), []
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(cut, (cut[a - 1] if a else 0) + PAIRS, side="right")))
        n = later[a:b]
        i = np.repeat(np.arange(a, b), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        s, t = col[i], col[j]
        add = divergence(p[i], p[j]) - divergence(p[i], none[t]) - divergence(none[s], p[j]) + divergence(none[s], none[t])
        found.append((s * len(none) + t, add))
        if len(found) > 8:
            found = [_reduced(found)]
        a = b
    key, value = _reduced(found) if found else (np.empty(0, np.int64),) * 2
    return key // max(1, len(none)), key % max(1, len(none)), value


def _reduced(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, value = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(value, first) if len(key) else value


def _compared(matrices: DataFrame, top: int) -> DataFrame:
    """kind, lang, source, item, count, value: `both` (pairs of sources, in order), `seen` (how many kept terms a source has count times) and `term` (the best `top` of each matrix)."""

    def run(batches):
        import pyarrow as pa

        for b in (x for x in batches if len(x)):
            out: list[list] = [[] for _ in range(6)]
            for lang, sources, matrix, v, names, totals in zip(*(b.column(c).to_pylist() for c in ("lang", "sources", "matrix", "v_all", "names", "sizes")), strict=True):
                words, indptr, col, count = pickle.loads(matrix)
                indptr, count = np.frombuffer(indptr, np.int64), np.frombuffer(count[1], count[0]).astype(np.int64)
                place = {n: i for i, n in enumerate(names)}
                col = np.array([place[s] for s in sources], np.int64)[np.frombuffer(col, np.int32)]
                row = np.repeat(np.arange(len(words)), np.diff(indptr))
                order = np.lexsort((col, row))
                col, count = col[order], count[order]
                whole = np.array(totals, np.int64) + 2 * v
                none, p = share(np.zeros(len(names), np.int64), whole), share(count, whole[col])
                q = share(np.add.reduceat(count, indptr[:-1]), np.int64(sum(totals) + 2 * v))[row]
                s, t, value = both_have(indptr, col, p, none)
                _extend(out, "both", lang, [names[i] for i in s.tolist()], [names[i].encode() for i in t.tolist()], [0] * len(s), value.tolist())
                pair, times = np.unique(np.stack((col, count)), axis=1, return_counts=True)
                _extend(out, "seen", lang, [names[i] for i in pair[0].tolist()], [b""] * len(times), pair[1].tolist(), times.tolist())
                more = np.flatnonzero(p > q)
                value = divergence(p[more], q[more])
                best = np.lexsort((row[more], -value, col[more]))
                c = col[more][best]
                first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.empty(0, np.int64)
                rank = np.arange(len(c)) - np.repeat(first, np.diff(np.concatenate((first, [len(c)]))))
                best = best[rank < top]
                _extend(out, "term", lang, [names[i] for i in col[more][best].tolist()], [words[i] for i in row[more][best].tolist()], [0] * len(best), value[best].tolist())
            kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["kind", "lang", "source", "item", "count", "value"])

    return matrices.mapInArrow(run, "kind string, lang string, source string, item binary, count long, value long")


def _extend(out: list[list], kind: str, lang: str, source: list, item: list, count: list, value: list) -> None:
    for o, x in zip(out, ([kind] * len(source), [lang] * len(source), source, item, count, value), strict=True):
        o.extend(x)


def _share(count: Column, whole: Column) -> Column:
    """share() as a column, with decimals."""
    return F.lit(1) + F.call_function("div", (count + 2).cast("decimal(28,0)") * F.lit(ONE).cast("decimal(10,0)"), whole.cast("decimal(28,0)"))


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10, top: int = 10, shards: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` (every other source of the language) and `term` (the `top` terms that a source uses more than its language)."""
    spark = docs.sparkSession
    short_batches(spark)
    text = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    base = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    shards = shards or min(MOST_SHARDS, max(LEAST_SHARDS, -(-text_bytes(base, "text") // SHARD_BYTES)))
    matrices = term_matrices(base, least, shards)
    seen = base.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n")).unionByName(matrices.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.totals").alias("n")))
    kept = matrices.groupBy("lang").agg(F.sum("v").alias("v"))
    groups = settle(seen.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(kept, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0))), "groups")
    langs = settle(groups.groupBy("lang").agg(F.max("v").alias("v_all"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g")).select("lang", "v_all", F.col("g.source").alias("names"), F.col("g.n").alias("sizes")), "languages")
    found = settle(_compared(matrices.select("lang", "sources", "matrix").join(small(langs), "lang"), top), "compared")

    full = groups.withColumns({"w": F.col("n") + 2 * F.col("v")})
    full = full.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.greatest("w", F.lit(1)))).otherwise(1))
    side = lambda a: full.select("lang", F.col("source").alias(f"s{a}"), F.col("p0").alias(f"p{a}"))
    none = full.select("lang", F.col("source").alias("s1"), F.col("p0").alias("p1"), "v").join(side(2), "lang").filter("s1 < s2").select("lang", "s1", "s2", (F.col("v") * _divergence(F.col("p1"), F.col("p2"))).alias("value"))
    times = found.filter("kind = 'seen'").groupBy("lang", "source", "count").agg(F.sum("value").alias("times"))
    times = times.join(full.select("lang", "source", "w", "p0"), ["lang", "source"]).select("lang", F.col("source").alias("s1"), F.col("p0").alias("p1"), _share(F.col("count"), F.col("w")).alias("p"), "times")
    one = times.join(side(2), "lang").filter("s1 <> s2").select("lang", F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2"), (F.col("times") * (_divergence(F.col("p"), F.col("p2")) - _divergence(F.col("p1"), F.col("p2")))).alias("value"))
    both = found.filter("kind = 'both'").select("lang", F.col("source").alias("s1"), F.col("item").cast("string").alias("s2"), "value")
    summed = settle(none.unionByName(one).unionByName(both).groupBy("lang", "s1", "s2").agg(F.sum("value").alias("value")), "pairs")
    pair = summed.select("lang", F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    term = found.filter("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", place).unionByName(term.withColumn("rank", place).filter(F.col("rank") <= top))
