"""Exact dedup by composable polynomial fingerprints.

The fingerprint of a text is the value of its UTF-8 bytes as a polynomial, modulo two primes. Values of chunks combine by
length-shifted arithmetic: H(xy) = H(x) * B^|y| + H(y). So a text over `huge_bytes` is cut into chunk rows that many tasks
hash, and their shifted values are summed; shorter texts are hashed whole. Texts with equal fingerprints are then compared
chunk by chunk: equal chunks at the same place are counted with map-side combining (a thousand copies travel as one chunk
per task), and where a place has more than one content, the group is split by its sequence of contents.

Defined results: null text counts as empty and equals other empty texts; of equal texts the row with the largest id stays
(null ids are smallest); of rows that also share the id, one stays; an empty table gives an empty result; other columns are
ignored by find_copies and kept by drop_copies.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.llm.common import join_hot, lean, quoted, settle, slices, small, spare, utf8

#: Two primes under 2^31, so that sums over a chunk fit 64 bits, and the base of the polynomial.
MODULI = (2147483629, 2147483587)
BASE = 1_000_003
CHUNK = 1 << 14
HUGE_BYTES = 8 << 20


def _powers(n: int, p: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:  # doubling: B^(i + done) = B^i * B^done
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(BASE, done, p)) % np.uint64(p)
        done += step
    return out[::-1].copy()


_POWERS = {p: _powers(CHUNK, p) for p in MODULI}


def chunk_hash(data: np.ndarray, p: int) -> int:
    """Of at most CHUNK bytes."""
    n = len(data)
    return int(np.dot(data.astype(np.uint64), _POWERS[p][CHUNK - n :] % np.uint64(p))) % p if n else 0


def combine(left: int, right: int, right_length: int, p: int) -> int:
    return (left * pow(BASE, right_length, p) + right) % p


def fingerprint(data: bytes, moduli: tuple[int, int] = MODULI) -> int:
    """Of whole bytes: chunks hashed one by one and combined; two residues in one 62-bit number."""
    buf, out = np.frombuffer(data, np.uint8), []
    for q, p in zip(moduli, MODULI, strict=True):
        h = 0
        for at in range(0, len(buf), CHUNK):
            part = buf[at : at + CHUNK]
            h = combine(h, chunk_hash(part, p), len(part), p)
        out.append(h % q)
    return out[0] << 31 | out[1]


def _shares(data: bytes, after: int) -> list[int]:
    """What a chunk with `after` bytes behind it adds to the residues of its text."""
    buf = np.frombuffer(data, np.uint8)
    return [chunk_hash(buf, p) * pow(BASE, int(after), p) % p for p in MODULI]


def _with_fingerprints(df: DataFrame, text: str, moduli: tuple[int, int]) -> DataFrame:
    schema = StructType([*df.schema.fields, StructField("fp", LongType())])

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(t, moduli) for t in utf8(b.column(text))], pa.int64())], names=[*b.schema.names, "fp"])

    return df.mapInArrow(lean(run), schema)


def _huge(df: DataFrame, moduli: tuple[int, int]) -> DataFrame:
    """Fingerprints of huge texts, their chunks hashed by many tasks."""
    cut = df.withColumn("rid", F.monotonically_increasing_id()).select("rid", "id", "n_bytes", "sha", F.encode("text", "UTF-8").alias("b"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_bytes - 1) div {CHUNK}"))).alias("i")
    parts = cut.select("rid", "id", "n_bytes", "sha", "b", at).select("rid", "id", "n_bytes", "sha", F.greatest(F.lit(0), F.col("n_bytes") - (F.col("i") + 1) * CHUNK).alias("after"), F.expr(f"substring(b, cast(i * {CHUNK} as int) + 1, {CHUNK})").alias("part")).repartition("rid", "after")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [_shares(p, n) for p, n in zip(b.column("part").to_pylist(), b.column("after").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "id", "n_bytes", "sha")), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["rid", "id", "n_bytes", "sha", "h0", "h1"])

    hashed = parts.mapInArrow(lean(run), StructType([*parts.select("rid", "id", "n_bytes", "sha").schema.fields, StructField("h0", LongType()), StructField("h1", LongType())]))
    residue = [F.sum(f"h{i}") % MODULI[i] % moduli[i] for i in (0, 1)]
    return hashed.groupBy("rid", "id", "n_bytes", "sha").agg((F.shiftleft(residue[0], 31).bitwiseOR(residue[1])).alias("fp")).drop("rid")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, huge_bytes: int = HUGE_BYTES, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """One row per row of docs: id, n_bytes, sha (SHA-256), fp."""
    base = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = _with_fingerprints(base.filter(F.col("n_bytes") <= huge_bytes), "text", moduli).withColumn("sha", F.sha2("text", 256)).drop("text")
    return short.unionByName(_huge(base.filter(F.col("n_bytes") > huge_bytes).withColumn("sha", F.sha2("text", 256)), moduli))


def _collisions(docs: DataFrame, id_col: str, text_col: str, groups: DataFrame, moduli: tuple[int, int], huge_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Chunks (fp, n_bytes, i, part) of the texts of groups, each content once with its count; and the groups of unequal texts."""
    base = docs.select(F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long")).filter("n_bytes > 0")
    # lengths are compared first: a text whose length no group has needs no hash
    lengths = groups.select("n_bytes").distinct()
    keyed = _with_fingerprints(base.join(F.broadcast(lengths) if _bounded(lengths) else lengths, "n_bytes", "left_semi").select("text", "n_bytes"), "text", moduli)
    keyed = keyed.join(small(groups.select("fp", "n_bytes")), ["fp", "n_bytes"], "left_semi")
    parts = keyed.select("fp", "n_bytes", F.encode("text", "UTF-8").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_bytes - 1) div {CHUNK}"))).alias("i")).select("fp", "n_bytes", "i", F.expr(f"substring(b, cast(i * {CHUNK} as int) + 1, {CHUNK})").alias("part"))
    chunks = parts.groupBy("fp", "n_bytes", "i", "part").agg(F.count(F.lit(1)).alias("copies"))
    return chunks, chunks.groupBy("fp", "n_bytes", "i").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("fp", "n_bytes").distinct()


def _bounded(lengths: DataFrame) -> bool:
    return lengths.limit(200_001).count() <= 200_000


def _split(docs: DataFrame, id_col: str, text_col: str, bad: DataFrame, moduli: tuple[int, int]) -> DataFrame:
    """For groups of unequal texts (none, but for chance): each text's class, the least digests of its contents in order."""
    base = docs.select(F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    keyed = _with_fingerprints(base, "text", moduli).join(small(bad), ["fp", "n_bytes"], "left_semi")
    once = keyed.groupBy("fp", "n_bytes", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("sha", F.sha2("text", 256))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_bytes - 1) div {CHUNK}"))).alias("i")
    parts = once.select("fp", "n_bytes", "sha", F.encode("text", "UTF-8").alias("b"), at).select("fp", "n_bytes", "sha", "i", F.expr(f"substring(b, cast(i * {CHUNK} as int) + 1, {CHUNK})").alias("part"))
    ranked = parts.withColumn("variant", F.dense_rank().over(Window.partitionBy("fp", "n_bytes", "i").orderBy("part")))
    return ranked.groupBy("fp", "n_bytes", "sha").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "variant"))), lambda x: x["variant"].cast("string")), ",").alias("class"))


def _groups(marks: DataFrame) -> DataFrame:
    return marks.groupBy("fp", "n_bytes", "class").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "rid")).alias("top"))


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = HUGE_BYTES, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, sha, fp, n_bytes, class."""
    marks = settle(fingerprints(docs, id_col, text_col, huge_bytes, moduli).withColumn("rid", F.monotonically_increasing_id()), "fingerprints")
    repeated = settle(marks.groupBy("fp", "n_bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    bad = settle(_collisions(docs, id_col, text_col, repeated, moduli, huge_bytes)[1], "unequal")
    if bad.isEmpty():
        marks = marks.withColumn("class", F.lit(""))
    else:
        classes = settle(_split(docs, id_col, text_col, bad, moduli), "classes")
        marks = settle(marks.join(classes, ["fp", "n_bytes", "sha"], "left").fillna("", ["class"]), "classed")
    total = marks.count()
    groups = settle(_groups(marks).filter("group_size > 1"), "groups")
    joined = join_hot(marks, groups, ["fp", "n_bytes", "class"], "group_size", total)
    top = F.coalesce(F.col("top"), F.struct("id", "rid"))
    return joined.select("id", top["id"].alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (top["rid"] == F.col("rid")).alias("kept"), "sha", "fp", "n_bytes", "class")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows without a copy go by without a shuffle."""
    found = settle(find_copies(docs, id_col, text_col), "copies")
    key, sha, stay, own = (spare(x, docs) for x in ("_id", "_sha", "_stay", "_sha_of"))
    gone = found.filter("not kept").select("id", "sha").distinct()
    kept = found.filter("kept and group_size > 1").select(F.col("id").alias("i"), F.col("sha").alias("s"), F.lit(1).alias("stay"))
    both = settle(gone.join(kept, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")), "left").select("id", "sha", F.coalesce("stay", F.lit(0))).toDF(key, sha, stay), "gone")
    keyed = docs.withColumn(own, F.sha2(F.coalesce(F.col(quoted(text_col)), F.lit("")), 256))
    marked = keyed.join(small(both), F.col(quoted(id_col)).eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha)), "left")
    clean = marked.filter(F.col(stay).isNull())
    twice = marked.filter(F.col(stay) == 1).dropDuplicates([id_col, own])  # the same id and text more than once: one of them
    return clean.unionByName(twice).select(*(F.col(quoted(c)) for c in docs.columns))
