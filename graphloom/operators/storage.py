"""Tables of the engine in the shared folder: cutting lineage, upserts by key, deletes, TTL."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a local one only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return (named or "file://" + tempfile.gettempdir()).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/graphloom-core/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_dealt(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """settle() into so many buckets by a key: what is joined or grouped by the key, or by it and more, needs no shuffle then (for joins by more, see dealt())."""
    spark, name = df.sparkSession, "dealt_" + uuid.uuid4().hex
    df.write.option("path", new_folder(spark, "table")).bucketBy(tasks, key).saveAsTable(name, format="parquet")
    got = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay, as those of settle()
    return got


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of a session for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dealt(spark: SparkSession):
    """While it holds, tables dealt by one of their keys are joined as they lie."""
    return settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.enabled": "true"})


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key new lacks, and all rows of new (null keys equal each other)."""
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new, on=[c for c in same], how="left_anti").unionByName(new.select(*old.columns))


def replace_workspace(df: DataFrame, path: str) -> None:
    """Write one workspace's rows; its old rows go, other workspaces stay."""
    df.sortWithinPartitions("id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id").parquet(path)


def delete_workspace(df: DataFrame, workspace: str) -> DataFrame:
    return df.filter(~F.col("workspace_id").eqNullSafe(workspace))


def live(df: DataFrame, updated: Column, now: Column, seconds: int) -> DataFrame:
    return df.filter(updated >= now - F.expr(f"INTERVAL {seconds} SECONDS"))
