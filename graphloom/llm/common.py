"""Shared helpers of the training-data operators: settled tables, size-checked joins, hashing of words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its files hold no more bytes than this, and, counted, it has no more rows than this.
BROADCAST_BYTES, BROADCAST_ROWS = 8 << 20, 200_000
#: A group counts as heavy when it holds more than one row in so many, so there are fewer heavy groups than this.
HEAVY_ONE_IN = 1000
#: What counts as a word in all operators here; white space is ASCII only.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a local one of our own only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        app = spark.sparkContext.applicationId
        named = _own_dir.setdefault(app, "file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches for Python have few rows, as a row may hold a long text. Set for the session, as plans run later."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, and survives lost executors."""
    short_batches(df.sparkSession)
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads, before any filter."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of the files that a plan reads; where a source doesn't know its size, the characters of the column, counted."""
    known = input_bytes(df)
    return known if known < 1 << 60 else int(df.agg(F.coalesce(F.sum(F.length(column)), F.lit(0))).first()[0])


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (a settled table), marked for broadcast if its files and a count show it to be small; else as it is, for a shuffled join."""
    return F.broadcast(df) if input_bytes(df) <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows else df


def spare(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that none of the frames has (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is in gone (a settled table of one column, no nulls). Rows without an id stay."""
    key = spare("_id", docs)
    return docs.join(small(gone.toDF(key)), F.col(quoted(id_col)).cast("long") == F.col(key), "left_anti")


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows with one row per key. Groups with over 1/HEAVY_ONE_IN of the rows are joined by broadcast
    (there are fewer than HEAVY_ONE_IN of them); the others by a shuffle, in which no key is large."""
    limit = max(1, total // HEAVY_ONE_IN)
    values = [c for c in groups.columns if c not in keys]
    heavy = F.broadcast(groups.filter(F.col(size) > limit))
    light = groups.filter(F.col(size) <= limit)
    first = rows.join(heavy, keys, "left")
    done = first.filter(F.col(size).isNotNull())
    rest = first.filter(F.col(size).isNull()).drop(*values).join(light, keys, "left")
    return done.unionByName(rest.select(*done.columns))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# ---------------------------------------------------------------- words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise; a permutation of 64-bit values."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_places = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _place(n: int) -> np.ndarray:
    """Odd random multipliers for the first n places of a word."""
    global _places
    if n > len(_places):
        _places = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _places[:n]


def _hash_block(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in a block of bytes, and where each begins."""
    word = ~_SPACE[buf]
    if not word.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, length = edge[::2], edge[1::2] - edge[::2]
    offset = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(int(length.sum())) - np.repeat(offset, length)
    value = (_LOWER[buf[word]].astype(np.uint64) + np.uint64(1)) * _place(int(length.max()))[place]
    return mix(np.add.reduceat(value, offset) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of some texts, in order, and how many words each text has.
    Works in blocks of about 1 MB cut at white space, so temporary memory is bounded by a block or the longest word."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    group: list[int] = []

    def flush() -> None:
        if group:
            joined = b" ".join(texts[i] for i in group)
            h, at = _hash_block(np.frombuffer(joined, np.uint8))
            ends = np.cumsum([len(texts[i]) + 1 for i in group])
            counts[group] = np.diff(np.concatenate(([0], np.searchsorted(at, ends))))
            hashes.append(h)
            group.clear()

    size = 0
    for i, t in enumerate(texts):
        if len(t) > _BLOCK:
            flush()
            size, at = 0, 0
            while at < len(t):
                end = min(len(t), at + _BLOCK)
                while end < len(t) and not _SPACE[t[end]]:
                    end += 1
                h, _ = _hash_block(np.frombuffer(t, np.uint8, end - at, at))
                counts[i] += len(h)
                hashes.append(h)
                at = end
            continue
        if size + len(t) > _BLOCK:
            flush()
            size = 0
        group.append(i)
        size += len(t) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def hash_of(word: str) -> np.uint64:
    return word_hashes([word.encode()])[0][0]


def utf8(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8; null counts as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def lean(run):
    """run (from an iterator of batches to one), after which the worker gives memory that it no longer uses back to the system: idle workers stay, and count for their executor."""

    @wraps(run)
    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def slices(batches: Iterator, column: str = "text", most: int = 2 << 20) -> Iterator:
    """The record batches cut into pieces of about `most` bytes of text (one row at least)."""
    import pyarrow as pa

    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column(column).cast(pa.large_binary()).buffers()[1], np.int64, len(batch) + 1, 8 * batch.column(column).offset) if len(batch) else np.zeros(1, np.int64))
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if i > at and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(n)
        if at < len(batch):
            yield batch.slice(at)
