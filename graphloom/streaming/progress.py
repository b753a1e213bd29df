"""Progress streams: suppress a message equal to the one before it, per stream; state expires after a while."""

from __future__ import annotations

from pyspark.sql import DataFrame


def suppress(key, batches, state, timeout_ms: int):
    """One stream's new rows: those whose message differs from the last one, which the state keeps until it times out."""
    import pandas as pd

    if state.hasTimedOut:
        state.remove()
        return
    started, last = state.exists, state.get[0] if state.exists else None
    rows, keep = pd.concat(list(batches)).sort_values("seq"), []
    for m in rows["message"]:
        m = None if pd.isna(m) else m
        keep.append(not started or m != last)
        last, started = m, True
    yield rows[keep][["stream_id", "seq", "message"]]
    state.update((last,))
    state.setTimeoutDuration(timeout_ms)


def distinct_runs(stream: DataFrame, timeout_ms: int = 3_600_000) -> DataFrame:
    """stream: stream_id long, seq long, message string. Emits the rows whose message differs from the stream's last one."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    step = lambda key, batches, state: suppress(key, batches, state, timeout_ms)
    return stream.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, seq long, message string", "last string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drain(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Write what a streaming query has now as Parquet, and end. State with a timeout by the clock asks for one more empty batch for ever, so a query over
    what is available never ended; without empty batches it does, and state times out in the next run that has data."""
    spark = rows.sparkSession
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
