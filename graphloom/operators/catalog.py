"""Stored graphs, workspaces, plans, logs and caches as tables of the shared folder."""

from __future__ import annotations

import json
from collections import OrderedDict
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalars import breadcrumb_key
from graphloom.operators import commits
from graphloom.operators.storage import upsert


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, workspace: str, version: int | None = None) -> int:
    """Save both tables as the next version, or as one that is free, and give its number. Readers see both tables of a version or neither."""
    return commits.save({"nodes": nodes, "edges": edges}, path, workspace, version)


def load_graph(spark: SparkSession, path: str, workspace: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a version, the latest by default."""
    tables = commits.record(spark, path, workspace, version)["tables"]
    if "nodes" not in tables:
        raise ValueError(f"No call graph found for workspace '{workspace}'")
    return spark.read.parquet(tables["nodes"]), spark.read.parquet(tables["edges"])


def graph_exists(spark: SparkSession, path: str, workspace: str) -> bool:
    return "nodes" in commits.record(spark, path, workspace)["tables"]


class GraphCache:
    """Loaded graphs that stay persisted, at most `size`; the one used longest ago goes first. An entry is one version, so a save is seen by the next load."""

    def __init__(self, size: int = 8):
        self.size, self._held = size, OrderedDict()

    def load(self, spark: SparkSession, path: str, workspace: str) -> tuple[DataFrame, DataFrame]:
        key = (path, workspace, commits.record(spark, path, workspace)["version"])
        if key in self._held:
            self._held.move_to_end(key)
            return self._held[key]
        self._held[key] = tuple(t.persist() for t in load_graph(spark, path, workspace))
        while len(self._held) > self.size:
            self._drop(next(iter(self._held)))
        return self._held[key]

    def _drop(self, key: tuple) -> None:
        for t in self._held.pop(key):
            t.unpersist()

    def clear(self) -> None:
        for key in list(self._held):
            self._drop(key)

    def __len__(self) -> int:
        return len(self._held)


def get_or_create(spark: SparkSession, path: str, owner: str, repo: str, branch: str | None = None) -> tuple[dict, bool]:
    """The workspace of owner and repo, and whether this call made it: of calls at the same time one does, and all get its record."""
    at = f"{path}/{quote(f'{owner}-{repo}', safe='')}.json"
    made = commits.put_once(spark, at, json.dumps({"workspace_id": f"{owner}-{repo}", "owner": owner, "repo": repo, "branch": branch}))
    return get_workspace(spark, path, owner, repo), made


def get_workspace(spark: SparkSession, path: str, owner: str, repo: str) -> dict | None:
    name = f"{quote(f'{owner}-{repo}', safe='')}.json"
    return json.loads(spark.read.text(f"{path}/{name}", wholetext=True).first()[0]) if name in commits.names_in(spark, path) else None


def list_workspaces(spark: SparkSession, path: str) -> DataFrame:
    """workspace_id, owner, repo, branch of all workspaces."""
    schema = "workspace_id string, owner string, repo string, branch string"
    names = [n for n in commits.names_in(spark, path) if n.endswith(".json")]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.text([f"{path}/{n}" for n in names], wholetext=True).select(F.from_json("value", schema).alias("w")).select("w.*")


def delete_workspace(spark: SparkSession, claims: str, data: str, owner: str, repo: str) -> bool:
    """Forget a workspace: all its tables in one record, then its claim. False if there is no such workspace."""
    if get_workspace(spark, claims, owner, repo) is None:
        return False
    commits.delete(spark, data, f"{owner}-{repo}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{claims}/{quote(f'{owner}-{repo}', safe='')}.json")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)
    return True


def edge_index(edges: DataFrame, *payload: str) -> DataFrame:
    return edges.select("source", "target", "type", *payload)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row; nulls are left out. Written as text it is a dump that reads back line by line."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def write_plan(plans: DataFrame, path: str, workspace: str) -> int:
    """Keep a workspace's plans (name, plan as JSON text), all at once; what was kept before goes."""
    return commits.save({"plans": plans.select("name", "plan")}, path, workspace)


def load_plan(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """name and plan; what isn't JSON counts as no plan (null). Without plans, no rows."""
    if "plans" not in commits.record(spark, path, workspace)["tables"]:
        return spark.createDataFrame([], "name string, plan string")
    return commits.load(spark, path, workspace, "plans").select("name", F.when(F.try_parse_json("plan").isNotNull(), F.col("plan")).alias("plan"))


def save_workflows(rows: DataFrame, path: str, workspace: str) -> int:
    """Add or replace workflows (entry, workflow) of a workspace by their entry."""
    spark = rows.sparkSession
    if "workflows" in commits.record(spark, path, workspace)["tables"]:
        rows = upsert(commits.load(spark, path, workspace, "workflows"), rows, ["entry"])
    return commits.save({"workflows": rows}, path, workspace)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """Plan documents as text, one per file; what isn't JSON is left out."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("plan")).filter(F.try_parse_json("plan").isNotNull())


def workspaces(rows: DataFrame) -> DataFrame:
    """workspace_id, owner, repo, branch, created: one row per workspace of references (owner, repo, branch, at); the first one made it."""
    return rows.groupBy(F.concat_ws("-", "owner", "repo").alias("workspace_id")).agg(*(F.min_by(c, "at").alias(c) for c in ("owner", "repo", "branch")), F.min("at").alias("created"))


def log_rows(calls: DataFrame, most: int = 2000) -> DataFrame:
    """day, kind, preview, ms: log lines of calls (at, kind, text, started), with texts of `most` characters."""
    ms = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000.0
    return calls.select(F.date_format("at", "yyyy-MM-dd").alias("day"), "kind", F.substring("text", 1, most).alias("preview"), ms.alias("ms"))


def event_lines(rows: DataFrame, *keep: str) -> DataFrame:
    """Server-sent events of rows (status, message, data as JSON text), with the columns to keep."""
    data = F.when(F.coalesce("data", F.lit("{}")) != "{}", F.concat(F.lit(', "data": '), F.col("data"))).otherwise("")
    text = lambda c: F.substring(F.to_json(F.array(F.col(c))), F.lit(2), F.length(F.to_json(F.array(F.col(c)))) - 2)
    return rows.select(*keep, F.concat(F.lit('data: {"status": '), text("status"), F.lit(', "message": '), text("message"), data, F.lit("}\n\n")).alias("value"))


def cached(cache: DataFrame, component: str, crumbs: Column, now: Column, days: int = 7) -> DataFrame:
    """The entry (component_id, key, saved, body) of a component under a path of breadcrumbs, unless it has expired."""
    return cache.filter((F.col("component_id") == component) & (F.col("key") == breadcrumb_key(crumbs)) & (F.col("saved") >= now - F.expr(f"INTERVAL {days} DAYS")))


def swept(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The entries that stay when expired ones are deleted."""
    return cache.filter(F.col("saved") >= now - F.expr(f"INTERVAL {days} DAYS"))


def pushed(crumbs: DataFrame, node: Column, now: Column, seconds: int = 3600) -> DataFrame:
    """cache_id, crumbs, saved: live breadcrumbs (cache_id, crumbs, saved) with a node added, each under a new id: pushes of one node onto one entry differ."""
    alive = crumbs.filter(F.col("saved") >= now - F.expr(f"INTERVAL {seconds} SECONDS")).withColumn("crumbs", F.array_append("crumbs", node))
    return alive.select(F.concat(F.lit("breadcrumbs_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)).alias("cache_id"), "crumbs", now.alias("saved"))
