"""Prefix trie of conversations: totals of all subtrees by peeling leaves.

Each conversation is rebuilt (the first turns of the conversation that opens its hundred, then its own), and every distinct sequence of first turns is a node.

1. Turns are sorted over the cluster by conversation and turn; a task numbers its own part and digests role and text (128 bits), and the parts of a conversation that lie in
   several tasks are joined up by their sizes. So no task holds a conversation.
2. The key of a node is its depth and two XORs of hashes of its turns with their places, running within chunks of CHUNK turns and carried on from chunk to chunk. All rows of a node must
   agree on the digest of their last turn and on their parent's key; the job fails if they don't, so a collision can't pass.
3. Nodes are aggregated by key. A run of nodes with the same members is one segment, as (least member, number of members) are the same along it and nowhere else.
4. Segments are peeled: each holds a counter of children that aren't finished and the totals so far. Finished segments send their totals to their parents, round after round, until the
   root finishes. A segment with one child left waits for it through a pointer, which skips, with its sums, what waits for one child too; so a chain of any length takes a number of rounds that grows with its logarithm.
5. The ids of conversations that end at one node are sorted over the cluster, packed, and hashed in order as a stream (SHA-256 can't be split, but the task holds one state and a packet).

Heavy conversations, parents and segments are joined apart by broadcast (fewer than 1,000 each).

Defined results: rows without a conversation id belong to none; null role or text counts as empty; a null turn comes first, and rows of equal turn go by role, then text, repeats included; an empty table has no
root and gives an empty result; further columns are ignored. Remainders have the sign of the id.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import join_hot, quoted, settle, short_batches, slices, utf8

#: Turns of a conversation that one window runs over; ids in a packet.
CHUNK, PACKET = 1000, 1024
_KEY = ["depth", "pa", "pb"]


def _numbered(rows: DataFrame) -> DataFrame:
    """conv, part, place (within its part), edge (in the first conversation of its part), lo, hi, chars."""

    def run(batches):
        import pyarrow as pa

        part, opens, last, done = TaskContext.get().partitionId(), None, None, 0
        for b in slices(batches):
            conv = b.column("conv").to_numpy(zero_copy_only=False)
            opens = int(conv[0]) if opens is None else opens
            first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            start = np.repeat(first, np.diff(np.concatenate((first, [len(conv)]))))
            place = np.arange(len(conv)) - start
            if conv[0] == last:
                place[start == 0] += done
            last, done = conv[-1], int(place[-1]) + 1
            both = np.frombuffer(b"".join(hashlib.blake2b(len(r).to_bytes(8, "little") + r + t, digest_size=16).digest() for r, t in zip(utf8(b.column("role")), utf8(b.column("text")), strict=True)), np.int64).reshape(-1, 2)
            cols = [pa.array(conv), pa.array(np.full(len(conv), part, np.int32)), pa.array(place), pa.array(conv == opens), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), b.column("chars")]
            yield pa.RecordBatch.from_arrays(cols, names=["conv", "part", "place", "edge", "lo", "hi", "chars"])

    return rows.mapInArrow(run, "conv long, part int, place long, edge boolean, lo long, hi long, chars long")


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, place (from 0), lo, hi (digest of role and text), chars: every turn in its conversation's order."""
    short_batches(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    rows = conversations.select(F.col(quoted(conv_col)).cast("long").alias("conv"), F.col(quoted(turn_col)).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).filter("conv is not null").withColumn("chars", F.length("text").cast("long"))
    # ranges may cut a conversation; their bounds hold the beginning of a text only
    ranged = rows.repartitionByRange("conv", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    turns = settle(_numbered(ranged), "turns")
    cut = turns.filter("edge").select("conv").distinct()  # one conversation a part at most
    sizes = turns.join(F.broadcast(cut), "conv", "left_semi").groupBy("conv", "part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("conv", "part", F.sum("size").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before")).filter("before is not null")
    whole = turns.join(F.broadcast(settle(before, "before")), ["conv", "part"], "left")  # fewer rows than parts
    return whole.select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "lo", "hi", "chars")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """conversations (conv, n, opener, h, shift, length) and their rebuilt turns (conv, depth, lo, hi, chars, end, length)."""
    opener = F.col("conv") - F.col("conv") % block
    sizes = settle(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumns({"opener": opener, "h": F.crc32(F.col("conv").cast("string")) % most}), "sizes")
    opens = sizes.filter("conv = opener").select("opener", F.col("n").alias("there"))
    shift = F.least("h", F.coalesce("there", F.lit(0)))
    convs = settle(sizes.join(opens, "opener", "left").select("conv", "n", "opener", "h", shift.alias("shift"), (shift + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    own = join_hot(turns, convs, ["conv"], "n", turns.count()).filter("place >= h")
    own = own.select("conv", (F.col("shift") + F.col("place") - F.col("h") + 1).alias("depth"), "lo", "hi", "chars", (F.col("place") == F.col("n") - 1).alias("end"), "length")
    heads = turns.filter((F.col("place") < most - 1) & (F.col("conv") % block == 0)).select(F.col("conv").alias("opener"), "place", "lo", "hi", "chars")
    lent = convs.filter("shift > 0").join(heads, "opener").filter("place < shift")  # a block's conversations times a few turns
    lent = lent.select("conv", (F.col("place") + 1).alias("depth"), "lo", "hi", "chars", (F.col("place") + 1 == F.col("length")).alias("end"), "length")
    return convs, own.unionByName(lent)


def paths(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each rebuilt turn with the key of its node (depth, pa, pb), its parent's (depth - 1, qa, qb), and the code points up to it."""
    one = turns.withColumns({"a": F.xxhash64("depth", "lo", "hi"), "b": F.xxhash64("hi", F.lit(7), "lo", "depth"), "chunk": F.floor(F.col("depth") / chunk)})
    run = Window.partitionBy("conv", "chunk").orderBy("depth")
    got = one.withColumns({"pa": F.bit_xor("a").over(run), "pb": F.bit_xor("b").over(run), "cum": F.sum("chars").over(run)})
    if not convs.filter(F.col("length") >= chunk).isEmpty():
        sums = one.filter(F.col("length") >= chunk).groupBy("conv", "chunk").agg(F.bit_xor("a").alias("a0"), F.bit_xor("b").alias("b0"), F.sum("chars").alias("c0"))
        so_far = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select("conv", "chunk", F.bit_xor("a0").over(so_far).alias("a0"), F.bit_xor("b0").over(so_far).alias("b0"), F.sum("c0").over(so_far).alias("c0")).filter("c0 is not null")
        got = got.join(before, ["conv", "chunk"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        got = got.withColumns({"pa": F.col("pa").bitwiseXOR(zero("a0")), "pb": F.col("pb").bitwiseXOR(zero("b0")), "cum": F.col("cum") + zero("c0")})
    return got.select("conv", "depth", "pa", "pb", F.col("pa").bitwiseXOR(F.col("a")).alias("qa"), F.col("pb").bitwiseXOR(F.col("b")).alias("qb"), "lo", "chars", "cum", "end")


def _ends() -> list[Column]:
    mine = F.when(F.col("end"), F.col("conv"))
    return [F.count(mine).alias("ends"), F.min(mine).alias("end_lo"), F.max(mine).alias("end_hi")]


def trie_nodes(walked: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, pa, pb, qa, qb, conv (least member), n (members), chars, cum, ends, end_lo, end_hi: one row per node, the root included."""
    got = walked.groupBy(*_KEY).agg(F.min("conv").alias("conv0"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"), F.max("cum").alias("cum"), *_ends(), F.min("qa").alias("qa"), F.max("qa").alias("qa_"), F.min("qb").alias("qb"), F.min("lo").alias("lo"), F.max("lo").alias("lo_"))
    same = F.expr("lo = lo_ and qa = qa_")
    got = got.filter(F.when(same, True).otherwise(F.raise_error(F.lit("two sequences of turns have one key"))))
    got = got.select(*_KEY, "qa", "qb", F.col("conv0").alias("conv"), "n", "chars", "cum", "ends", "end_lo", "end_hi")
    zero = F.lit(0).cast("long")
    none = convs.withColumn("end", F.col("length") == 0).agg(F.min("conv").alias("conv0"), F.count(F.lit(1)).alias("n"), *_ends()).filter("n > 0")
    none = none.select(*(zero.alias(c) for c in (*_KEY, "qa", "qb")), F.col("conv0").alias("conv"), "n", zero.alias("chars"), zero.alias("cum"), "ends", "end_lo", "end_hi")
    return got.unionByName(none)


def segments(nodes: DataFrame) -> DataFrame:
    """Runs of nodes with the same members: conv, n, top, bottom (depths), size, cum0, cum1 (code points before and through it), own (what its nodes save), its parent (p_conv, p_n) and
    kids, kx, kn (number and XORs of its children's ids)."""
    top, bottom = F.min(F.struct("depth", "qa", "qb", (F.col("cum") - F.col("chars")).alias("cum0"))), F.max(F.struct("depth", "pa", "pb", "cum"))
    runs = nodes.groupBy("conv", "n").agg(top.alias("t"), bottom.alias("b"), F.count(F.lit(1)).alias("size"))
    runs = settle(runs.select("conv", "n", F.col("t.depth").alias("top"), F.col("b.depth").alias("bottom"), "size", F.col("t.cum0").alias("cum0"), F.col("b.cum").alias("cum1"), F.col("b.pa").alias("pa"), F.col("b.pb").alias("pb"), (F.col("t.depth") - 1).alias("up"), F.col("t.qa").alias("up_a"), F.col("t.qb").alias("up_b")), "runs")
    at = ["up", "up_a", "up_b"]
    kids = runs.filter("top > 0").groupBy(*at).agg(F.count(F.lit(1)).alias("kids"), F.bit_xor("conv").alias("kx"), F.bit_xor("n").alias("kn"))
    ends = runs.select(F.col("bottom").alias("up"), F.col("pa").alias("up_a"), F.col("pb").alias("up_b"), F.col("conv").alias("p_conv"), F.col("n").alias("p_n"))
    parents = settle(kids.join(ends, at), "parents")
    placed = join_hot(runs, parents.drop("kx", "kn"), at, "kids", runs.count()).drop("kids", *at, "pa", "pb")
    mine = parents.select(F.col("p_conv").alias("conv"), F.col("p_n").alias("n"), "kids", "kx", "kn")
    own = (F.col("n") - 1) * (F.col("cum1") - F.col("cum0"))
    return settle(placed.join(mine, ["conv", "n"], "left").withColumns({"own": own, "kids": F.coalesce("kids", F.lit(0))}), "segments")


def peel(segs: DataFrame) -> tuple[DataFrame, int]:
    """conv, n, leaves, saved of every segment's subtree, and in how many rounds."""
    no = F.lit(None).cast("long")
    one_left = F.col("kids") == 1
    state = segs.select("conv", "n", "p_conv", "p_n", F.col("kids").alias("open"), "kx", "kn", F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.col("own").alias("saved"), F.when(one_left, F.col("kx")).alias("w_conv"), F.when(one_left, F.col("kn")).alias("w_n"))
    columns, finished, rounds = state.columns, [], 0
    while True:
        done, live = state.filter("open = 0"), state.filter("open > 0")
        finished.append(done.select("conv", "n", "leaves", "saved"))
        if live.isEmpty():
            break
        rounds += 1
        sent = done.filter("p_conv is not null").groupBy(F.col("p_conv").alias("conv"), F.col("p_n").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.bit_xor("conv").alias("x"), F.bit_xor("n").alias("y"))
        wide = live.filter("w_conv is null").join(sent, ["conv", "n"], "left").withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in "clsxy"})
        wide = wide.withColumns({"open": F.col("open") - F.col("c"), "leaves": F.col("leaves") + F.col("l"), "saved": F.col("saved") + F.col("s"), "kx": F.col("kx").bitwiseXOR(F.col("x")), "kn": F.col("kn").bitwiseXOR(F.col("y"))})
        wide = wide.withColumns({"w_conv": F.when(F.col("open") == 1, F.col("kx")), "w_n": F.when(F.col("open") == 1, F.col("kn"))}).select(columns)
        # what a segment with one child left waits for: finished now or earlier, or itself waiting for one, or else waiting for several
        seen = live.select(F.col("conv").alias("w_conv"), F.col("n").alias("w_n"), "leaves", "saved", F.lit(False).alias("over"), F.col("w_conv").alias("v_conv"), F.col("w_n").alias("v_n"))
        # leaves are looked for in the first round only, which skips nothing: after it, nothing waits for a leaf
        for f in finished if rounds == 1 else finished[1:]:
            seen = seen.unionByName(f.select(F.col("conv").alias("w_conv"), F.col("n").alias("w_n"), "leaves", "saved", F.lit(True).alias("over"), no.alias("v_conv"), no.alias("v_n")))
        seen = seen.select("w_conv", "w_n", F.col("leaves").alias("l"), F.col("saved").alias("s"), "over", "v_conv", "v_n")
        thin = live.filter("w_conv is not null").join(seen, ["w_conv", "w_n"], "left")
        skip = F.col("over") | F.col("v_conv").isNotNull() if rounds > 1 else F.col("over")
        thin = thin.withColumns({"open": F.when(F.col("over"), 0).otherwise(F.col("open")).cast("long"), "leaves": F.col("leaves") + F.when(skip, F.col("l")).otherwise(0), "saved": F.col("saved") + F.when(skip, F.col("s")).otherwise(0)})
        thin = thin.withColumns({"w_conv": F.when(skip, F.col("v_conv")).otherwise(F.col("w_conv")), "w_n": F.when(skip, F.col("v_n")).otherwise(F.col("w_n"))}).select(columns)
        state = settle(wide.unionByName(thin), f"peeled-{rounds}")
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out, rounds


# ---------------------------------------------------------------- ids that end at a node


def _packed(rows: DataFrame) -> DataFrame:
    """Sorted rows (node, depth, conv) as packets of comma-joined ids: node, depth, first, ids."""

    def run(batches):
        import pyarrow as pa

        for b in (x for x in batches if len(x)):
            node, depth, conv = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "depth", "conv"))
            new = np.concatenate(([True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])))
            new[::PACKET] = True
            first = np.flatnonzero(new)
            ends = np.concatenate((first[1:], [len(conv)]))
            ids = [",".join(map(str, conv[x:y].tolist())).encode() for x, y in zip(first.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array(depth[first]), pa.array(conv[first]), pa.array(ids, pa.binary())], names=["node", "depth", "first", "ids"])

    return rows.mapInArrow(run, "node long, depth long, first long, ids binary")


def _hashed(packets: DataFrame) -> DataFrame:
    """conv, depth, sha: packets in order of node, depth and first id, hashed as a stream."""

    def run(batches):
        import pyarrow as pa

        now, state = None, None
        for b in batches:
            out = []
            for node, depth, ids in zip(b.column("node").to_pylist(), b.column("depth").to_pylist(), b.column("ids"), strict=True):
                if (node, depth) != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (node, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
            yield _sha_rows(pa, out)
        if now:
            yield _sha_rows(pa, [(*now, state.hexdigest())])

    return packets.mapInArrow(run, "conv long, depth long, sha string")


def _sha_rows(pa, rows: list[tuple[int, int, str]]):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv", "depth", "sha"])


def shared_ends(nodes: DataFrame, walked: DataFrame, convs: DataFrame) -> DataFrame | None:
    """conv, depth, sha of the nodes at which more than two conversations end; None if there are no such nodes."""
    many = nodes.filter("ends > 2").select(*_KEY, F.col("conv").alias("node"), "ends")
    if many.isEmpty():
        return None
    zero = F.lit(0).cast("long")
    ending = walked.filter("end").select("conv", *_KEY).unionByName(convs.filter("length = 0").select("conv", *(zero.alias(c) for c in _KEY)))
    rows = join_hot(ending, many, _KEY, "ends", convs.count()).filter("node is not null").select("node", "depth", "conv")
    rows = rows.repartitionByRange("node", "depth", "conv").sortWithinPartitions("node", "depth", "conv")
    return _hashed(_packed(rows).repartition("node", "depth").sortWithinPartitions("node", "depth", "first"))


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(ordered_turns(conversations, conv_col, turn_col, role_col, text_col))
    walked = settle(paths(turns, convs, chunk), "paths")
    nodes = settle(trie_nodes(walked, convs), "nodes")
    segs = segments(nodes)
    totals, _ = peel(segs)
    known = settle(segs.join(totals, ["conv", "n"]).select("conv", "n", "top", "bottom", "size", "cum1", "own", "kids", "p_conv", "leaves", "saved"), "totals")
    full = join_hot(nodes, known, ["conv", "n"], "size", nodes.count())
    text = lambda c: F.col(c).cast("string")
    few = F.when(F.col("ends") == 0, F.lit("")).when(F.col("ends") == 1, text("end_lo")).when(F.col("ends") == 2, F.concat_ws(",", text("end_lo"), text("end_hi")))
    sha = F.sha2(few, 256)
    if (shared := shared_ends(nodes, walked, convs)) is not None:
        full = full.join(shared, ["conv", "depth"], "left")
        sha = F.coalesce("sha", sha)
    parent = F.when(F.col("depth") > 0, F.when(F.col("depth") == F.col("top"), F.col("p_conv")).otherwise(F.col("conv")))
    children = F.when(F.col("depth") == F.col("bottom"), F.col("kids")).otherwise(1).cast("long")
    saved = F.col("saved") - F.col("own") + (F.col("n") - 1) * (F.col("cum1") - F.col("cum") + F.col("chars"))
    return full.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), children.alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), sha.alias("ends_sha256"))
