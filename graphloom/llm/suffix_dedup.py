"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that starts anywhere else in the corpus too.

Sharding. In each window of `length` bytes the GRAM-byte string of least hash (the leftmost of equals) is the window's anchor, so two
equal windows have equal anchors at equal offsets. Windows of a text that follow one another with the same anchor make a context: the
bytes they cover. Equal windows thus lie in contexts of one anchor, and anchors that occur once are dropped. Contexts with equal
bytes count as one with a multiplicity, so copies travel once.

Deciding. The contexts of an anchor's shard are joined into one text with separators; its suffix array gives the Burrows-Wheeler
transform, and breadth-first backward extension over the transform sets the longest common prefix of neighbouring suffixes by increasing
value, stopping at `length`: what is then unset is at least that long. The intervals between set places are equal windows; an
interval is repeated if the multiplicities in it sum to two or more. A shard with one context needs no array, since its
multiplicity decides. An anchor with more than MOST_CONTEXTS contexts is too large for a task: its contexts are cut again by anchors that are longer
by a quarter of `length`, which are shared by fewer texts, and these shards go through arrays in turn. Anchors as long as a window end this, since all their
contexts are equal.

Defined results: null text is empty; a text shorter than `length` keeps all its bytes; windows never cross documents; equal
texts (repeated rows, null ids) get equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import join_hot, mix, quoted, settle, slices, utf8

GRAM = 100
MOST_CONTEXTS = 1000
#: Bytes of contexts that are sorted at once, and of a text that are scanned at once.
BLOCK, PIECE = 1 << 19, 1 << 22
#: Contexts of a task that makes arrays, about.
TASK_CONTEXTS = 8000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_pow: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    got = _pow.get(int(base))
    if got is None or len(got) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = _pow[int(base)] = np.multiply.accumulate(got)
    return got[:n]


def runs(buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a text of `length` bytes or more: the anchors' hashes, and the first and last window of each."""
    value = buf.astype(np.uint64) + np.uint64(1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * _powers(_BASE, len(buf)), dtype=np.uint64)))
    h = mix((total[gram:] - total[:-gram]) * _powers(_INVERSE, len(buf) - gram + 1) + np.uint64(gram))
    w = length - gram + 1
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(key) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    n = len(key) - w + 1
    place = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return h[place[first]], first, last


def text_runs(text: bytes, length: int, gram: int):
    """runs() of a text of any size, scanned in overlapping pieces. A context never crosses a piece's border, which lies at a
    multiple of PIECE windows; that only splits a context, and the same windows get the same anchors."""
    windows = len(text) - length + 1
    for at in range(0, max(0, windows), PIECE):
        n = min(PIECE, windows - at)
        h, a, b = runs(np.frombuffer(text, np.uint8, n + length - 1, at), length, gram)
        yield h, a + at, b + at


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of s (symbols under 512) in the order of their first `depth` symbols at least, by prefix doubling."""
    n, h = len(s), 7
    padded = np.concatenate((s.astype(np.uint64), np.zeros(h, np.uint64)))
    key = np.zeros(n, np.uint64)
    for i in range(h):
        key = (key << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    ordered = key[order]
    start = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    at = np.flatnonzero(start)
    rank[order] = np.repeat(at, np.diff(np.concatenate((at, [n]))))
    while h < depth:
        size = np.diff(np.concatenate((at, [n])))
        open_ = np.repeat(size > 1, size)
        where = np.flatnonzero(open_)
        if not len(where):
            break
        who = order[where]
        nxt = who + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        if n < 1 << 21:  # both ranks and the place fit one number, and plain sorting is several times as fast as sorting places
            packed = rank[who].astype(np.uint64) << np.uint64(42) | second.astype(np.uint64) << np.uint64(21) | who.astype(np.uint64)
            packed.sort()
            order[where] = (packed & np.uint64((1 << 21) - 1)).astype(np.int64)
            k = packed >> np.uint64(21)
        else:
            key2 = rank[who].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
            resorted = np.argsort(key2)
            order[where] = who[resorted]
            k = key2[resorted]
        fresh = np.concatenate(([True], k[1:] != k[:-1]))
        start[where] = fresh
        at = np.flatnonzero(start)
        rank[order] = np.repeat(at, np.diff(np.concatenate((at, [n]))))
        h *= 2
    return order


def long_prefixes(s: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For i in 1..n-1, whether the suffixes order[i-1] and order[i] share `length` symbols or more: by breadth-first backward extension
    over the transform, which meets common prefixes by increasing value and sets each once. s ends in a symbol less than all others."""
    n = len(s)
    bwt = s[order - 1].astype(np.uint16)  # order 0 gives the last symbol: the text as a circle
    lf = np.empty(n, np.int64)
    back = np.argsort(bwt, kind="stable")
    lf[back] = np.arange(n)
    sorted_ = bwt[back]
    nxt, prv = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    same = sorted_[1:] == sorted_[:-1]
    nxt[back[:-1][same]] = back[1:][same]
    prv[back[1:][same]] = back[:-1][same]
    change = np.flatnonzero(np.concatenate((bwt[1:] != bwt[:-1], [True]))) + 1
    run_end = np.repeat(change, np.diff(np.concatenate(([0], change))))
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    lo, hi = np.array([0], np.int64), np.array([n], np.int64)
    for _ in range(length):
        if not len(lo):
            break
        even = run_end[lo] >= hi  # one symbol stands before all of it (or it is one suffix): one extension
        single, end = lf[lo[even]], lf[hi[even] - 1] + 1
        fresh = ~found[end]
        wide_lo, wide_hi = lo[~even], hi[~even]
        new_lo, new_hi = [single[fresh]], [end[fresh]]
        if len(wide_lo):
            size = wide_hi - wide_lo
            p = np.arange(int(size.sum())) + np.repeat(wide_lo - np.concatenate(([0], np.cumsum(size)[:-1])), size)
            tail = nxt[p] >= np.repeat(wide_hi, size)
            head = prv[p] < np.repeat(wide_lo, size)
            iv = np.repeat(np.arange(len(size)), size)
            a, b = p[head], p[tail]
            a, b = a[np.argsort(iv[head] * 512 + bwt[a])], b[np.argsort(iv[tail] * 512 + bwt[b])]
            i, j = lf[a], lf[b] + 1
            fresh = ~found[j]
            new_lo.append(i[fresh])
            new_hi.append(j[fresh])
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        found[hi] = True
        # of intervals that end at one place, the first counts: a boundary is set once
        if len(hi) > 1:
            hi, keep = np.unique(hi, return_index=True)
            lo = lo[keep]
    return ~found[1:n]


def repeated_windows(contexts: list[bytes], copies: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its windows occur twice or more among all contexts, each counted with its copies."""
    ends = np.cumsum([len(c) + 1 for c in contexts])
    s = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.uint16) + 2
    s[ends - 1] = 1
    s[-1] = 0  # one least symbol ends the text, so that suffixes are ordered as the transform needs
    order = suffix_array(s, length)
    joined = long_prefixes(s, order, length)
    owner = np.searchsorted(ends, order, side="right")
    window = ends[owner] - 1 - order >= length
    weight = np.where(window, np.asarray(copies, np.int64)[owner], 0)
    group = np.concatenate(([0], np.cumsum(~joined)))
    often = np.bincount(group, weight)[group] >= 2
    hit = np.zeros(len(s), bool)
    hit[order] = often & window
    return [hit[e - 1 - len(c) : e - length] for c, e in zip(contexts, ends, strict=True)]


def _flat(hit: np.ndarray) -> list[int]:
    """First and last of each run of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8)))
    edge[1::2] -= 1
    return edge.tolist()


def _halves(data: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(data)
    return (d >> 64) - (1 << 63), (d & (2**64 - 1)) - (1 << 63)


def _anchors(base: DataFrame, length: int, gram: int, full: bool) -> DataFrame:
    """hash; if full also c0, c1 (digest of the context), d0, d1 (digest of the text), id, ws, we."""
    names = ["hash", "c0", "c1", "d0", "d1", "id", "ws", "we"] if full else ["hash"]

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            ids, cols = b.column("id").to_pylist(), [[] for _ in names]
            for key, text in zip(ids, utf8(b.column("text")), strict=True):
                if len(text) < length:
                    continue
                d = _halves(text) if full else None
                for h, first, last in text_runs(text, length, gram):
                    cols[0].append(h.view(np.int64))
                    if full:
                        got = [_halves(text[x : y + length]) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                        for k, v in ((1, [g[0] for g in got]), (2, [g[1] for g in got]), (3, [d[0]] * len(h)), (4, [d[1]] * len(h)), (5, [key] * len(h)), (6, first.tolist()), (7, last.tolist())):
                            cols[k].extend(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

    return base.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _with_digest(base: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            got = [_halves(t) for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["id", "text", "d0", "d1"])

    return base.mapInArrow(run, "id long, text string, d0 long, d1 long")


_CONTEXT = "hash long, c0 long, c1 long, n long, ctx binary"


def _cut(base: DataFrame, owners: DataFrame, length: int) -> DataFrame:
    """The bytes of contexts, each cut from the text that owns it."""
    wanted = settle(owners.groupBy("d0", "d1", "id").agg(F.collect_list(F.struct("hash", "c0", "c1", "n", "ws", "we")).alias("cut")), "owners")
    texts = _with_digest(base)
    right = wanted.withColumnRenamed("id", "_id")  # grows with the input: never broadcast
    joined = texts.join(right, (texts["d0"] == right["d0"]) & (texts["d1"] == right["d1"]) & texts["id"].eqNullSafe(right["_id"])).select("text", "cut")

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("hash", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64()), ("n", pa.int64()), ("ctx", pa.binary())])
        for b in slices(batches):
            rows = [{k: x[k] for k in ("hash", "c0", "c1", "n")} | {"ctx": text[x["ws"] : x["we"] + length]} for text, cut in zip(utf8(b.column("text")), b.column("cut").to_pylist(), strict=True) for x in cut]
            for at in range(0, len(rows), 4000):
                yield pa.RecordBatch.from_pylist(rows[at : at + 4000], schema=schema)

    # rows that repeat an owner's id and text cut the same contexts
    return joined.mapInArrow(run, _CONTEXT)


_RESULT = "hash long, c0 long, c1 long, hits array<int>"


def _by_arrays(contexts: DataFrame, length: int, contexts_in_all: int) -> DataFrame:
    """hits (first and last of runs of windows, flat) of the contexts of each anchor, by arrays."""
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("hash", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64()), ("hits", pa.list_(pa.int32()))])
        held: dict = {}
        size = 0

        def done():
            got = repeated_windows([c for c, _ in held.values()], [n for _, n in held.values()], length)
            rows = [{"hash": k[0], "c0": k[1], "c1": k[2], "hits": _flat(hit)} for k, hit in zip(held, got, strict=True) if hit.any()]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        last = None
        for b in batches:
            for h, c0, c1, n, ctx in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if h != last and size >= BLOCK:  # a shard is never split
                    yield done()
                    size = 0
                last = h
                if (h, c0, c1) not in held:
                    held[h, c0, c1] = ctx, n
                    size += len(ctx)
        if held:
            yield done()

    tasks = max(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-contexts_in_all // TASK_CONTEXTS))
    return contexts.repartition(tasks, "hash").sortWithinPartitions("hash").mapInArrow(run, _RESULT)


def _cut_again(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Contexts cut by longer anchors: hash, c0, c1 of the context, n, at (first window in it), hash2, e0, e1 (digest of the part), ctx (its bytes)."""

    def run(batches):
        import pyarrow as pa

        names = ["hash", "c0", "c1", "n", "at", "hash2", "e0", "e1", "ctx"]
        for b in batches:
            cols = [[] for _ in names]
            for h, c0, c1, n, ctx in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                anchors, first, last = runs(np.frombuffer(ctx, np.uint8), length, gram)
                # equal windows agree in both anchors, so the pair of them is the shard
                for a, x, y in zip(mix(anchors ^ np.uint64(h & (2**64 - 1))).view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True):
                    part = ctx[x : y + length]
                    for col, v in zip(cols, (h, c0, c1, n, x, a, *_halves(part), part if gram < length else b""), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], names=names)

    return contexts.dropDuplicates(["hash", "c0", "c1"]).mapInArrow(run, "hash long, c0 long, c1 long, n long, at long, hash2 long, e0 long, e1 long, ctx binary")


def _by_longer_anchors(contexts: DataFrame, length: int, gram: int, most_contexts: int) -> DataFrame:
    """hits of the contexts of crowded anchors, by shards of anchors of `gram` bytes; those still crowded by longer ones."""
    parts = settle(_cut_again(contexts, length, gram), "parts")
    once = settle(parts.groupBy("hash2", "e0", "e1").agg(F.sum("n").alias("n"), F.min("ctx").alias("ctx")).withColumnsRenamed({"hash2": "hash", "e0": "c0", "e1": "c1"}), "parts-once")
    if gram == length:  # a part is one window, and its copies decide
        return _moved(parts, once.filter("n > 1").select("hash", "c0", "c1", F.array(F.lit(0), F.lit(0)).alias("hits")))
    total = once.count()
    shards = settle(once.groupBy("hash").agg(F.count(F.lit(1)).alias("k")), "shards")
    kinds = join_hot(once, shards, ["hash"], "k", total)
    alone = kinds.filter("k = 1 and n > 1").select("hash", "c0", "c1", F.array(F.lit(0), (F.octet_length("ctx") - length).cast("int")).alias("hits"))
    results = alone.unionByName(_by_arrays(kinds.filter((F.col("k") > 1) & (F.col("k") <= most_contexts)).select("hash", "c0", "c1", "n", "ctx"), length, total))
    crowd = settle(kinds.filter(F.col("k") > most_contexts).select("hash", "c0", "c1", "n", "ctx"), "crowd")
    if not crowd.isEmpty():
        results = results.unionByName(_by_longer_anchors(crowd, length, min(length, gram + max(1, length // 4)), most_contexts))
    return _moved(parts, results)


def _moved(parts: DataFrame, results: DataFrame) -> DataFrame:
    """hits of contexts from those of their parts."""
    results = settle(results.withColumnsRenamed({"hash": "hash2", "c0": "e0", "c1": "e1"}), "parts-repeated")
    moved = F.transform("hits", lambda x: (x + F.col("at")).cast("int"))
    found = parts.select("hash", "c0", "c1", "at", "hash2", "e0", "e1").join(results, ["hash2", "e0", "e1"])
    return found.groupBy("hash", "c0", "c1").agg(F.flatten(F.sort_array(F.collect_list(moved))).alias("hits"))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int | None = None, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """d0, d1 (digest of a text), starts: array of (first, last) runs of repeated windows. Only texts that have some."""
    gram = gram or min(GRAM, max(1, length // 4))
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    long_ = base.filter(F.octet_length("text") >= length)
    often = settle(_anchors(long_, length, gram, False).groupBy("hash").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "anchors")
    total = int(often.agg(F.coalesce(F.sum("often"), F.lit(0))).first()[0])
    seen = settle(join_hot(_anchors(long_, length, gram, True), often, ["hash"], "often", total).filter("often is not null").drop("often"), "seen")
    owner = F.min(F.struct("d0", "d1", "id", "ws", "we"))
    contexts = settle(seen.groupBy("hash", "c0", "c1").agg(F.count(F.lit(1)).alias("n"), owner.alias("o")), "contexts")
    shards = settle(contexts.groupBy("hash").agg(F.count(F.lit(1)).alias("k")), "shards")
    total = contexts.count()
    kinds = join_hot(contexts, shards, ["hash"], "k", total).select("hash", "c0", "c1", "n", "k", "o.*")
    kinds = settle(kinds, "kinds")
    alone = kinds.filter("k = 1 and n > 1").select("hash", "c0", "c1", F.array(F.lit(0), (F.col("we") - F.col("ws")).cast("int")).alias("hits"))
    several = _by_arrays(_cut(long_, kinds.filter((F.col("k") > 1) & (F.col("k") <= most_contexts)), length), length, total)
    crowd = kinds.filter(F.col("k") > most_contexts)
    results = alone.unionByName(several)
    if not crowd.isEmpty():
        results = results.unionByName(_by_longer_anchors(_cut(long_, crowd, length), length, min(length, gram + max(1, length // 4)), most_contexts))
    results = settle(results.join(contexts.select("hash", "c0", "c1", "n"), ["hash", "c0", "c1"]), "repeats")
    placed = join_hot(seen, results, ["hash", "c0", "c1"], "n", seen.count()).filter("hits is not null")
    spans = placed.groupBy("d0", "d1").agg(F.collect_set(F.struct("ws", "hits")).alias("at"))
    return settle(spans, "spans")


def _covered(at: list[dict], length: int) -> list[tuple[int, int]]:
    """Removed byte runs, merged, in order."""
    pairs = sorted((x["ws"] + a, x["ws"] + b + length) for x in at for a, b in zip(x["hits"][::2], x["hits"][1::2], strict=True))
    out: list[tuple[int, int]] = []
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_text: bool = False, **more) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256; with_text: also kept (bytes)."""
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    spans = find_repeats(docs, id_col, text_col, length, **more)
    # spans grow with the input: never broadcast; texts of very many copies are split by adaptive execution
    joined = _with_digest(base).join(spans, ["d0", "d1"], "left").select("id", "text", "at")
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows = []
            for key, text, at in zip(b.column("id").to_pylist(), utf8(b.column("text")), b.column("at").to_pylist(), strict=True):
                gone = _covered(at, length) if at else []
                ends = [0, *(x for g in gone for x in g), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True)) if gone else text
                rows.append((key, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: len(names)], names=names)

    return joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
