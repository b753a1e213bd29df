"""Near-duplicate documents by MinHash: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A document's set holds its distinct shingles of `words` words (fewer words: the whole sequence; no words: empty, linked with
nothing). Documents with equal sets are one class. Each class gets BINS one-permutation minima; an empty bin takes the value of
the bin that its own sequence of keyed probes meets first (optimal densification). BANDS bands of ROWS minima make buckets.
In a bucket the candidates form a star around a centre, and every candidate link is confirmed on the full sets. Members
that are still in another component than the centre are tried again: in a bucket of up to MORE_CENTRES + 1 members around each other one, in a larger one around FEW_CENTRES of its largest component,
so that only the few outside of that make rows. A bucket that holds several components even then is dealt into blocks of bounded size, and each two of its blocks, but for two of its largest component, meet in a unit that
compares full sets of different components and gives only links: so no link between members of a bucket is lost, a
bucket of one component costs one star, and no pair of a large bucket becomes a row.

Bands are as narrow as a miss rate under MISS at the least similarity asks for: 36 bands of 7 at 0.85 (a link shares no bucket with a chance of
1e-6, were bins independent), 42 bands of 6 at 0.80 (3e-6). A test measures it on small and large sets.

Defined results: null text is empty. A class is known by a number of its own, so rows without an id, or ids that repeat on different texts, stay apart; class_id and
component_id are the least id there is (null if all rows lack one). kept is true where the id equals component_id, and, in a component that has no id at all, for
every row; a row without an id beside rows with ids isn't kept. Repeated rows have equal sets; empty tables give
empty results; very long texts are hashed in blocks; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import join_hot, lean, mix, quoted, settle, slices, small, utf8, word_hashes

BINS, MISS = 252, 5e-6
#: Centres of a bucket's second round of stars: all members that are left of a small bucket, some of its largest component in a larger one.
MORE_CENTRES, FEW_CENTRES = 7, 3
#: Mean members and mean bytes of sets in a block of a bucket that stars did not settle.
BLOCK_SETS, BLOCK_BYTES = 128, 2 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
#: Probes of each empty bin that are drawn at once.
_PROBES = (mix((np.arange(BINS, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(64, dtype=np.uint64)[None, :] + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)


def band_rows(percent: int) -> int:
    """The most minima a band may hold for links of the least similarity to miss all bands with a chance under MISS."""
    t = percent / 100
    return max(r for r in range(1, 64) if r == 1 or (BINS % r == 0 and (1 - t**r) ** (BINS // r) < MISS))


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles in a sequence of word hashes."""
    if not len(h):
        return h
    if len(h) < words:
        out = np.array([len(h)], np.uint64)
        for i in range(len(h)):
            out = mix(out * _ODD[0] + h[i : i + 1])
        return out
    n = len(h) - words + 1
    out = np.full(n, words, np.uint64)
    for i in range(words):
        out = mix(out * _ODD[0] + h[i : i + n]) if i == words - 1 else out * _ODD[i % 5] + mix(h[i : i + n] + np.uint64(i))
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """BINS minima of a non-empty set: one permutation, bins by the high part, then optimal densification."""
    x = np.sort(mix(s + _ODD[1]))[::-1]
    part = ((x >> np.uint64(40)) % np.uint64(BINS)).astype(np.int64)
    out = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    out[part] = x  # in falling order, so the least of a bin is written last
    full[part] = True
    empty = np.flatnonzero(~full)
    k = 0
    while len(empty):
        probes = _PROBES[empty, k : k + 4] if k < 64 else (mix((empty.astype(np.uint64)[:, None] << np.uint64(32)) + np.arange(k + 1, k + 65, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64)
        hit = full[probes]
        some = hit.any(1)
        out[empty[some]] = out[probes[some, hit[some].argmax(1)]]
        empty = empty[~some]
        k += probes.shape[1]
    return out


def buckets(sigs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per signature and band of `rows` minima; the band is part of it."""
    bands = BINS // rows
    m = sigs.reshape(-1, bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(m), 1))
    for i in range(rows):
        out = mix(out * _ODD[2] + m[:, :, i])
    return out


def _sets(batch, text: str, words: int):
    texts = utf8(batch.column(text))
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    for a, b in zip(ends - counts, ends, strict=True):
        yield shingles(h[a:b], words)


def _digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (2**64 - 1)) - (1 << 63)


def set_marks(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n_shingles, s0, s1 (a 128-bit digest of the set; null when empty)."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, "text"):
            rows = [(len(s), *(_digest(s) if len(s) else (None, None))) for s in _sets(b, "text", words)]
            n, s0, s1 = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(s0, pa.int64()), pa.array(s1, pa.int64())], names=["id", "n_shingles", "s0", "s1"])

    base = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    return base.mapInArrow(lean(run), "id long, n_shingles long, s0 long, s1 long")


def _class_buckets(docs: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """s0, s1, bucket: of every text, with repeats among copies."""
    per_band = band_rows(percent)
    bands = BINS // per_band

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, "text"):
            seen, keys, s0, s1 = set(), [], [], []
            for s in _sets(b, "text", words):
                if len(s) and (d := _digest(s)) not in seen:
                    seen.add(d)
                    keys.append(signature(s))
                    s0.append(d[0])
                    s1.append(d[1])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(s0, np.int64), bands)), pa.array(np.repeat(np.array(s1, np.int64), bands)), pa.array(buckets(np.stack(keys), per_band).view(np.int64).ravel())], names=["s0", "s1", "bucket"])

    return docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(lean(run), "s0 long, s1 long, bucket long")


def _full_sets(docs: DataFrame, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """c, shingles (sorted 64-bit hashes as bytes): the full sets of the wanted classes (c, s0, s1)."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, "text"):
            rows = {_digest(s): s for s in _sets(b, "text", words) if len(s)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.int64()), pa.array([k[1] for k in rows], pa.int64()), pa.array([s.tobytes() for s in rows.values()], pa.binary())], names=["s0", "s1", "shingles"])

    sets = docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(lean(run), "s0 long, s1 long, shingles binary")
    return sets.join(small(wanted), ["s0", "s1"]).select("c", "shingles").dropDuplicates(["c"])


def components(links: DataFrame) -> DataFrame:
    """v, label (least vertex reachable) for links (a, b), by alternating large and small stars until nothing changes."""
    edges, before = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc"), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        spread = large.join(low, "u")
        edges = settle(spread.select(F.col("v").alias("u"), F.col("m").alias("v")).union(spread.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select("u", "v").groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "v")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B|, on full sets."""
    a, b = sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        import pyarrow as pa

        for x in batches:
            keep = []
            for p, q in zip(x.column("sa"), x.column("sb"), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                few, many = (p, q) if len(p) <= len(q) else (q, p)
                if 100 * len(few) < percent * len(many):
                    keep.append(False)
                    continue
                at = np.searchsorted(many, few)
                both = int((many[np.minimum(at, len(many) - 1)] == few).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def block_links(ids: np.ndarray, labels: np.ndarray, block: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different components, between two blocks of a bucket or within one. Links that close a circle are left out."""
    first = block == block.min()
    rows = np.flatnonzero(first)
    others = rows if first.all() else np.flatnonzero(~first)
    value, place = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    end = np.cumsum(size)
    places = [place[e - n : e] for e, n in zip(end, size, strict=True)]
    flat = np.concatenate([places[i] for i in others])
    starts = np.cumsum(size[others]) - size[others]
    root, seen, out = np.unique(labels, return_inverse=True)[1], np.zeros(len(value), bool), []
    for i in rows:
        if not (root[others] != root[i]).any():
            continue
        seen[places[i]] = True
        both = np.add.reduceat(seen[flat], starts, dtype=np.int64)
        seen[places[i]] = False
        for j in others[100 * both >= percent * (size[i] + size[others] - both)]:
            if root[i] != root[j]:
                out.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return out


def _links_in_blocks(state: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between the components that share a bucket in state (bucket, c, label)."""

    def run(unit):
        import pyarrow as pa

        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit.column("shingles")]
        found = block_links(*(unit.column(x).to_numpy() for x in ("c", "label", "own")), held, percent)
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    sizes = settle(sets.select("c", F.octet_length("shingles").cast("long").alias("bytes")), "set-sizes")
    weighed = settle(state.join(small(sizes), "c"), "weighed")

    def number(n, size):
        return F.ceil(F.greatest(n / BLOCK_SETS, size / BLOCK_BYTES))

    # the largest component of a bucket has blocks of its own, which need not meet each other
    parts = weighed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    whole = parts.groupBy("bucket").agg(F.max(F.struct("n", "size", "label")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = settle(whole.select("bucket", "n", F.col("most.label").alias("largest"), number(F.col("most.n"), F.col("most.size")).alias("inner"), number(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("rest")), "blocks")
    placed, key = join_hot(weighed, blocks, ["bucket"], "n", weighed.count()), F.xxhash64("c")
    inner = F.col("label") == F.col("largest")
    own = placed.withColumn("own", F.when(inner, F.col("rest") + F.pmod(key, F.col("inner"))).otherwise(F.pmod(key, F.col("rest"))))
    last = F.when(inner, F.col("rest")).otherwise(F.col("rest") + F.col("inner")) - 1
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))).select("bucket", "c", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.join(sets, "c").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def link_classes(docs: DataFrame, classes: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """v, label: components of the classes (c, s0, s1), c being the number of a class."""
    keyed = _class_buckets(docs, text_col, words, percent)
    once = settle(keyed.distinct(), "buckets")
    shared = once.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = once.join(shared, "bucket").select("bucket", "s0", "s1", "n")
    # buckets with the same members are one
    placed = settle(members.join(small(classes), ["s0", "s1"]).select("bucket", "c", "n"), "members")
    alike = placed.groupBy("bucket", "n").agg(F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("k0"), F.sum(F.xxhash64(F.lit(1), "c").cast("decimal(38,0)")).alias("k1")).groupBy("n", "k0", "k1").agg(F.min("bucket").alias("bucket"))
    members = settle(placed.join(alike.select("bucket"), "bucket", "left_semi").select("bucket", "c"), "members")
    wanted = settle(classes.join(members.select("c").distinct(), "c", "left_semi"), "wanted")
    sets = settle(_full_sets(docs, text_col, words, wanted), "sets")
    spark: SparkSession = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    label = members.select(F.col("c").alias("v"), F.col("c").alias("label")).distinct()
    state, done, tested = members.withColumn("label", F.col("c")), None, None
    for step in (1, MORE_CENTRES):
        # the centres of this round: the next `step` members of each bucket, in the order of a keyed hash
        rank = F.struct(F.xxhash64("c").alias("h"), F.col("c"))
        open_ = state.withColumn("rank", rank)
        if done is None:  # one centre each: an aggregate, combined before the shuffle
            centres = open_.groupBy("bucket").agg(F.min(F.struct("rank", "label")).alias("x")).select("bucket", F.col("x.rank").alias("rank"), F.col("x.rank.c").alias("a"), F.col("x.label").alias("la"))
        else:
            parts = state.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
            whole = parts.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("largest"), (F.sum("n") <= step + 1).alias("few"))
            left = open_.join(done, "bucket").filter(F.col("rank") > F.col("last")).join(whole, "bucket").filter("few or label = largest")
            place = F.row_number().over(Window.partitionBy("bucket").orderBy("rank"))
            centres = left.withColumn("place", place).filter(F.col("place") <= F.when(F.col("few"), step).otherwise(FEW_CENTRES)).select("bucket", "rank", F.col("c").alias("a"), F.col("label").alias("la"))
        centres = settle(centres, "centres")
        pairs = state.join(centres, "bucket").filter("label <> la").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
        pairs = settle(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = settle(_confirm(pairs, sets, percent), "links")
        if not found.isEmpty():
            links = links.union(found)
            label = settle(components(links), "labels")
        last = centres.groupBy("bucket").agg(F.max("rank").alias("last"))
        done = last if done is None else last.unionByName(done).groupBy("bucket").agg(F.max("last").alias("last"))
        named = members.join(done, "bucket").join(label.withColumnRenamed("v", "c"), "c", "left").select("bucket", "c", F.coalesce("label", "c").alias("label"), "last")
        # a bucket goes on while it has two components and a member that has not been a centre, which a larger one always has
        more = F.max(F.struct(F.xxhash64("c").alias("h"), F.col("c")) > F.col("last")) | (F.count(F.lit(1)) > MORE_CENTRES + 1)
        mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), more.alias("more")).filter("lo <> hi and more").select("bucket")
        state = settle(named.join(mixed, "bucket", "left_semi").select("bucket", "c", "label"), "state")
        if state.isEmpty():
            return label
    found = settle(_links_in_blocks(state, sets, percent), "links")
    return label if found.isEmpty() else settle(components(links.union(found)), "labels")


def find_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, class_id (least id with an equal set), component_id, kept."""
    marks = settle(set_marks(docs, id_col, text_col, words), "sets-of")
    empty = marks.filter("s0 is null")
    grouped = marks.filter("s0 is not null").groupBy("s0", "s1").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    classes = settle(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay as they are
    label = link_classes(docs, classes.select("c", "s0", "s1"), text_col, words, percent)
    named = classes.join(label.withColumnRenamed("v", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    named = settle(named.select("s0", "s1", "n", "class_id", "label"), "named")
    # a component of one class is that class; the least id of the others
    joint = settle(named.groupBy("label").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "joint")
    found = named.join(small(joint.withColumn("_joint", F.lit(True))), "label", "left")
    found = settle(found.select("s0", "s1", "n", "class_id", F.when(F.col("_joint"), F.col("component_id")).otherwise(F.col("class_id")).alias("component_id")), "components")
    full = join_hot(marks.filter("s0 is not null"), found, ["s0", "s1"], "n", marks.count())
    out = full.select("id", "n_shingles", "class_id", "component_id").unionByName(empty.select("id", "n_shingles", F.col("id").alias("class_id"), F.col("id").alias("component_id")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
