"""Exact top-k search in binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension (set where the value is above 0). Equal codes are one entry of the index, which keeps its k + 1 least
ids: that suffices for any top k, so a vector that a third of all rows share is one entry. The distinct codes are dealt into blocks by a hash, each small enough for a task, and
the query codes, in groups, meet every block. In a block the codes are cut into segments about EXTRA bits wider than the block's size has (wider segments prune better, and
larger blocks allow them), each with an index by value. A query looks up what lies at distance
0 of its own value in one segment after the other, then at distance 1, and so on, and verifies what it meets with the full Hamming distance. After
radius r in segments 0..j, and r - 1 in the others, every code within r * segments + j bits has been met (pigeonhole), so the query stops when
its (k + 1)-th verified distance is at most that. Where a radius has more values than the segment has different ones, the segment's own values are
gone through instead of the radius: the same codes are met.

Defined results: a null vector, and a row with a null id, is neither indexed nor a query; all elements count, and a shorter vector's missing ones and null ones count as 0; a query is not its own neighbour, but
equal vectors are; ties go to the least id; ids that repeat with one vector count once; fewer than k rows give as many neighbours as there are; further columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import settle, short_batches

#: Bits of a segment beyond those of the block's size, and its most bits.
EXTRA, WIDEST = 5, 24
#: Codes of a block at most, when there are many; queries that meet a block in one task, at most and, while tasks are few, about.
BLOCK, QUERIES, FEW_QUERIES = 1 << 18, 1 << 19, 64
FEW_TASKS = 256


def code_words(vector: Column, dims: int) -> list[Column]:
    """The code as 64-bit numbers."""
    bit = lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    padded = F.transform(F.sequence(F.lit(1), F.lit(-(-dims // 64) * 64)), lambda i: F.try_element_at(vector, i))
    return [F.aggregate(F.slice(padded, 1 + 64 * w, 64), F.lit(0).cast("long"), bit) for w in range(-(-dims // 64))]


@cache
def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64)


class Index:
    """Multi-index over distinct codes: (n, words) of 64-bit numbers. verified: how many codes the last query compared in full."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.verified = codes, 0
        total = 64 * codes.shape[1]
        count = -(-total // min(WIDEST, max(8, int(len(codes)).bit_length() + EXTRA)))
        self.cuts = [total * i // count for i in range(count + 1)]
        self.values, self.first, self.order = [], [], []
        for part in self._parts(codes):
            order = np.argsort(part, kind="stable")
            values, first = np.unique(part[order], return_index=True)
            self.order.append(order)
            self.values.append(values)
            self.first.append(np.concatenate((first, [len(codes)])))

    def _parts(self, codes: np.ndarray) -> list[np.ndarray]:
        """The segments of codes, each as numbers. A segment may lie across two words."""
        out = []
        for lo, hi in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            value = np.zeros(len(codes), np.uint64)
            for w in range(lo // 64, (hi - 1) // 64 + 1):
                a, b = max(lo, 64 * w), min(hi, 64 * w + 64)
                piece = (codes[:, w] >> np.uint64(a - 64 * w)) & np.uint64((1 << (b - a)) - 1)
                value |= piece << np.uint64(a - lo)
            out.append(value.astype(np.int64))
        return out

    def _at(self, s: int, own: int, radius: int, far: dict[int, np.ndarray]) -> np.ndarray:
        """Places of the codes whose segment s is at the distance from own."""
        width, values = self.cuts[s + 1] - self.cuts[s], self.values[s]
        if s in far or comb(width, radius) > len(values):
            if s not in far:
                far[s] = np.bitwise_count(values ^ own)
            v = np.flatnonzero(far[s] == radius)
        else:
            wanted = own ^ _masks(width, radius)
            v = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            v = v[values[v] == wanted]
        a = self.first[s][v]
        size = self.first[s][v + 1] - a
        if not len(v):
            return v
        return self.order[s][np.arange(int(size.sum())) + np.repeat(a - np.cumsum(size) + size, size)]

    def nearest(self, query: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of codes that hold the k nearest rows (each code counts weights rows) with all ties."""
        n, segments = len(self.codes), len(self.order)
        own = [int(x[0]) for x in self._parts(query[None, :])]
        met = np.zeros(n, bool)
        held = np.zeros(64 * self.codes.shape[1] + 2, np.int64)  # rows verified at each distance
        places, distances, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], {}
        widest = max(b - a for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True))
        for step in range(segments * (widest + 1)):
            radius, s = divmod(step, segments)
            at = self._at(s, own[s], radius, far)
            at = at[~met[at]]
            if len(at):
                met[at] = True
                d = np.bitwise_count(self.codes[at] ^ query).sum(1, dtype=np.int64)
                np.add.at(held, d, weights[at])
                places.append(at)
                distances.append(d)
            if held[: step + 1].sum() >= k:
                break
        at, d = np.concatenate(places), np.concatenate(distances)
        self.verified = len(at)
        full = np.flatnonzero(np.cumsum(held) >= k)
        keep = d <= (full[0] if len(full) else len(held))
        return at[keep], d[keep]


def search(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, neighbor_id, distance for every row for which `queries` is true. Codes are as long as the longest vector."""
    short_batches(rows.sparkSession, 10_000)
    dims = max(1, rows.filter(F.col(id_col).isNotNull()).agg(F.max(F.size(vector_col))).first()[0] or 1)
    words = -(-dims // 64)
    c = [f"c{w}" for w in range(words)]
    coded = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("is_query"), *(x.alias(n) for x, n in zip(code_words(F.col(vector_col), dims), c, strict=True)))
    coded = settle(coded, "codes")
    first = F.row_number().over(Window.partitionBy(*c).orderBy("id"))
    few = coded.select("id", *c).distinct().withColumn("r", first).filter(F.col("r") <= k + 1)  # a limit per group, applied before the shuffle too
    index = settle(few.groupBy(*c).agg(F.sort_array(F.collect_list("id")).alias("ids")), "index")
    total = index.count()
    asked = settle(coded.filter("is_query").select("id", *c).distinct(), "queries")
    waiting, blocks = asked.count(), max(1, -(-total // block))
    groups = max(1, -(-waiting // QUERIES), min(-(-waiting // FEW_QUERIES), FEW_TASKS // blocks))
    tasks = min(blocks * groups, 1 << 16)
    codes = index.withColumn("block", F.pmod(F.xxhash64(*c), F.lit(blocks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    wanted = asked.select(*c).distinct().withColumn("group", F.pmod(F.xxhash64(*c), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left, right):
        import pyarrow as pa

        out: list[list] = [[] for _ in range(words + 2)]
        if len(left) and len(right):
            x = np.ascontiguousarray(np.stack([left.column(n).to_numpy().astype(np.int64) for n in c], 1)).view(np.uint64)
            y = np.ascontiguousarray(np.stack([right.column(n).to_numpy().astype(np.int64) for n in c], 1)).view(np.uint64)
            ids = left.column("ids").to_pylist()
            weights, built = np.array([len(i) for i in ids], np.int64), Index(x)
            for q in y:
                at, d = built.nearest(q, weights, k + 1)
                best = sorted((int(dist), i) for p, dist in zip(at.tolist(), d, strict=True) for i in ids[p])[: k + 1]
                for w in range(words):
                    out[w].extend([int(q[w].view(np.int64))] * len(best))
                out[-2].extend(b[0] for b in best)
                out[-1].extend(b[1] for b in best)
        return pa.table([pa.array(o, pa.int32() if i == words else pa.int64()) for i, o in enumerate(out)], names=[*c, "distance", "neighbor_id"])

    schema = ", ".join([*(f"{n} long" for n in c), "distance int", "neighbor_id long"])
    # a number of partitions of its own: small tables, much work
    left, right = (x.repartition(tasks, "block", "group").groupBy("block", "group") for x in (codes, wanted))
    near = left.cogroup(right).applyInArrow(run, schema)
    best = F.row_number().over(Window.partitionBy(*c).orderBy("distance", "neighbor_id"))
    top = near.withColumn("r", best).filter(F.col("r") <= k + 1).drop("r")
    each = asked.withColumnRenamed("id", "query_id").join(top, c).filter("query_id <> neighbor_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
