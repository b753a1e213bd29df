"""Keyed state of streams: progress events that end, breadcrumbs that expire, messages in order of their last arrival."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from graphloom.operators.storage import settings

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _seq(r: Row) -> tuple[bool, int]:
    return r.seq is None, r.seq or 0


def _events(key, batches, state, ttl_ms: int):
    """Log rows whose message differs from the last one, then one end or error row; what follows that is left out. The state comes and goes with the rows, many streams at once."""
    import pandas as pd

    if state.hasTimedOut:
        state.remove()
        return
    last, ended = state.get if state.exists else ("", False)
    some = list(batches)
    some = some[0] if len(some) == 1 else pd.concat(some, ignore_index=True)
    if not some["seq"].is_monotonic_increasing:
        some = some.sort_values("seq", kind="stable")
    keep = []
    for kind, m in zip(some["kind"].tolist(), some["message"].tolist(), strict=True):
        m = "" if m is None or m != m else m
        keep.append(not ended and (kind != "log" or bool(m) and m != last))
        if kind == "log":
            last = m or last
        else:
            ended = True
    state.update((last, ended))
    state.setTimeoutDuration(ttl_ms)
    yield some[["stream_id", "seq", "kind", "message"]] if all(keep) else some.loc[keep, ["stream_id", "seq", "kind", "message"]]


def progress_events(logs: DataFrame, ttl_seconds: int = 86_400) -> DataFrame:
    """stream_id, seq, kind, message of a stream of logs (stream_id long, seq long, kind, message): kind is log, end or error. Equal neighbours and empty messages are left out, and whatever comes
    after a stream's end. Null messages count as empty. State goes after a day without rows."""
    step = lambda key, batches, state: _events(key, batches, state, 1000 * ttl_seconds)
    return logs.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, seq long, kind string, message string", "last string, ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


_EPOCH, _MICRO, _NEVER = datetime(1970, 1, 1), timedelta(microseconds=1), -(2**63) // 1000


def crumbs_id(workspace: str, seq: int) -> str:
    return "breadcrumbs_" + hashlib.md5(f"{workspace}#{seq}".encode()).hexdigest()[:12]


class _Crumbs(StatefulProcessor):
    """Lists of breadcrumbs, never changed: a push makes a new one. A workspace's batch asks the state twice at most: one pass over its lists when a push wants one that no push before it in the batch made, one append of
    what it makes."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle) -> None:
        self.lists = handle.getListState("lists", "cache_id string, crumbs string, saved long", 1000 * self.ttl)

    def handleInputRows(self, key, rows, timer_values):
        batch = sorted(rows, key=_seq)
        ids, made = [crumbs_id(key[0], r.seq) for r in batch], {}
        wanted = {r.cache_id for r in batch if r.cache_id is not None}
        held = None
        for r, new in zip(batch, ids, strict=True):
            at, text, error = _NEVER if r.at is None else (r.at.replace(tzinfo=None) - _EPOCH) // _MICRO, None, None
            node = json.loads(r.node)
            mine = {k: node.get(k) for k in ("node_key", "title", "node_type", "target_id")} | ({"metadata": {"action_parameters": node["action_parameters"]}} if node.get("action_parameters") else {})
            mine = json.dumps(mine, ensure_ascii=False, separators=(",", ":"))
            if r.cache_id is None:
                text = f"[{mine}]"
            else:
                got = made.get(r.cache_id)
                if got is None:
                    held = {k: (crumbs, saved) for k, crumbs, saved in self.lists.get() if k in wanted} if held is None else held
                    got = held.get(r.cache_id)
                if got is None or at - got[1] > 1_000_000 * self.ttl:
                    error = f"Cache {r.cache_id} not found or expired"
                else:
                    text = f"{got[0][:-1]},{mine}]"
            if text is not None:
                made[new] = (text, at)
            yield Row(workspace=key[0], seq=r.seq, cache_id=None if error else new, crumbs=text, error=error)
        if made:
            self.lists.appendList([(k, *v) for k, v in made.items()])

    def close(self) -> None:
        pass


def breadcrumb_pushes(requests: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """workspace, seq, cache_id, crumbs (JSON), error of a stream of requests (workspace string, seq long, at timestamp, cache_id, node as JSON): a request without an id begins a list with its node, one with an
    id adds its node to that list under a new id, which workspace and seq give; so two pushes of one node have two ids, and a replay gives the same. A list lives for ttl_seconds, by the
    requests' times; the state store forgets it after as long by the clock."""
    return requests.groupBy("workspace").transformWithState(_Crumbs(ttl_seconds), "workspace string, seq long, cache_id string, crumbs string, error string", "Append", "ProcessingTime")


def last_arrivals(logs: DataFrame) -> DataFrame:
    """stream_id, message, last_seen: a repeated message moves to the end of its stream's list. Streaming state is one number per (stream, message)."""
    return logs.groupBy("stream_id", "message").agg(F.max("seq").alias("last_seen"))


# ---------------------------------------------------------------- sinks


def _once(path: str):
    """A sink for foreachBatch: each batch has a folder of its own, which a repeated batch replaces."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return put


def event_sink(path: str):
    """_once() for progress_events(): their lines as server-sent events, with an end or error line per stream."""
    put, data = _once(path), F.lit(None).cast("string")

    def lines(rows: DataFrame, batch: int) -> None:
        from graphloom.operators.catalog import event_lines

        named = rows.select("stream_id", "seq", F.when(F.col("kind") == "log", "analyzing").when(F.col("kind") == "end", "complete").otherwise("error").alias("status"), F.coalesce("message", F.lit("")).alias("message"), data.alias("data"))
        put(event_lines(named, "stream_id", "seq"), batch)

    return lines


def run_available(rows: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Run a streaming query over what there is now, batch by batch, into a sink, and end. State with a clock asks for empty batches for ever, so there are none."""
    with settings(rows.sparkSession, {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.providerClass": _ROCKS}):
        rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a sink has written, with its batch."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)
