"""Tables of a workspace that change together: data first, then one record that names it.

A save writes its tables into folders of their own and then puts a record, numbered one higher than the last, that names the folders of all the workspace's tables. Readers go by the newest record,
so they see a save as a whole or not at all, and a delete of several tables is one record without them. Of several writers of one number one wins; the others take the next.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless it is there: False then. Of writers at the same time one succeeds."""
    if path.startswith(("file:", "/")):
        local = "/" + path.removeprefix("file:").lstrip("/")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}.part"
        with open(part, "w") as out:
            out.write(text)
        try:
            os.link(part, local)  # fails if the name is taken
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(part, False)
    out.write(text.encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(part, at, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:  # which class it comes as depends on the store
        store.delete(part, False)
        if "AlreadyExists" in str(e):
            return False
        raise


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders of a folder; none if it is missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in store.listStatus(at) if not x.getPath().getName().endswith(".part")) if store.exists(at) else []


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small record


def _root(path: str, workspace: str) -> str:
    return f"{path}/{quote(workspace, safe='')}"


def versions(spark: SparkSession, path: str, workspace: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in names_in(spark, f"{_root(path, workspace)}/commits") if n.endswith(".json"))


def record(spark: SparkSession, path: str, workspace: str, version: int | None = None) -> dict:
    """The newest record, or that of a version: {"version", "tables": {name: folder}}; no tables if there is none."""
    known = versions(spark, path, workspace)
    version = known[-1] if version is None and known else version
    return {"version": version, **_read(spark, f"{_root(path, workspace)}/commits/{version:08d}.json")} if version in known else {"version": None, "tables": {}}


def write(df: DataFrame, path: str, workspace: str, name: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a table into a folder of its own, which nothing reads before a record names it."""
    folder = f"{_root(path, workspace)}/data/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(folder)
    return folder


def commit(spark: SparkSession, path: str, workspace: str, change, version: int | None = None) -> int:
    """Put the next record (or that of a version, which must be free). change: from the newest record's tables to the new ones; called again when another writer was first."""
    while True:
        last = record(spark, path, workspace)
        number = (last["version"] or 0) + 1 if version is None else version
        if put_once(spark, f"{_root(path, workspace)}/commits/{number:08d}.json", json.dumps({"tables": change(dict(last["tables"]))})):
            return number
        if version is not None:
            raise ValueError(f"version {version} of {workspace} is there already")


def save(tables: dict[str, DataFrame], path: str, workspace: str, version: int | None = None) -> int:
    """Replace some of a workspace's tables, all at once; its other tables stay."""
    spark = next(iter(tables.values())).sparkSession
    folders = {name: write(df, path, workspace, name) for name, df in tables.items()}
    return commit(spark, path, workspace, lambda old: old | folders, version)


def load(spark: SparkSession, path: str, workspace: str, name: str, version: int | None = None) -> DataFrame:
    folder = record(spark, path, workspace, version)["tables"].get(name)
    if folder is None:
        raise ValueError(f"no {name} for workspace '{workspace}'")
    return spark.read.parquet(folder)


def workspaces_of(spark: SparkSession, path: str) -> list[str]:
    """Workspaces that have tables."""
    return [w for w in map(unquote, names_in(spark, path)) if record(spark, path, w)["tables"]]


def everywhere(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """workspace_id and a table's columns, over all workspaces that have it."""
    parts = [spark.read.parquet(f).withColumn("workspace_id", F.lit(w)) for w in workspaces_of(spark, path) if (f := record(spark, path, w)["tables"].get(name))]
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def delete(spark: SparkSession, path: str, workspace: str) -> bool:
    """Drop all tables of a workspace in one record; False if it has none. Readers of older versions are not disturbed."""
    if not record(spark, path, workspace)["tables"]:
        return False
    commit(spark, path, workspace, lambda old: {})
    return True
