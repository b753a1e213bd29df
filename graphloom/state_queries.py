"""Queries of streams with state, committed tables and caches, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import catalog, commits, storage
from graphloom.operators.response_cache import ResponseCache
from graphloom.plans import adapter as A
from graphloom.registry import query
from graphloom.streaming import state

#: Parts in which the events of a stream arrive, and files of a part; a stream's rows of a part lie in one file, and files are read in the order they were written.
_PARTS, _FILES = 3, 4


def _arriving(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows as a stream of several batches: ranges of the order, one after the other."""
    spark, folder = rows.sparkSession, storage.new_folder(rows.sparkSession, "arriving")
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((F.col(order) - F.lit(lo or 0)) * _PARTS / F.lit((hi or 0) - (lo or 0) + 1)), F.lit(_PARTS - 1))
    for i in range(_PARTS):
        rows.filter(part == i).repartition(_FILES, key).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _FILES).parquet(folder)


_SHOWN = "CASE event_id % 6 WHEN 0 THEN 'Calling ' || event_type || '...' WHEN 1 THEN 'Got results from ' || event_type WHEN 2 THEN 'Analyzing results...' WHEN 3 THEN CASE WHEN value > 50 THEN 'Starting analysis...' ELSE 'Finalizing components...' END WHEN 4 THEN CASE WHEN value > 50 THEN 'Finalizing navigation nodes...' ELSE 'Generating structured response...' END END"


@query(f"""WITH x AS (SELECT 1), e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AS last, {_SHOWN} AS m FROM events),
l AS (SELECT user_id, event_id, m, lag(m) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e WHERE NOT last AND m IS NOT NULL)
SELECT user_id AS stream_id, event_id AS seq, 'data: {{"status": "analyzing", "message": "' || m || '"}}' || chr(10) || chr(10) AS value FROM l WHERE p IS DISTINCT FROM m
UNION ALL SELECT user_id, event_id, 'data: {{"status": "' || CASE WHEN event_type = 'error' THEN 'error", "message": "boom' ELSE 'complete", "message": "' END || '"}}' || chr(10) || chr(10) FROM e WHERE last""")
def event_sink_lines(spark, d):
    e, k, big = A.table(spark, d, "events"), F.col("event_id") % 6, F.col("value") > 50
    log = F.when(k == 0, F.concat(F.lit("[tool:start] "), "event_type", F.lit(" x"))).when(k == 1, F.concat(F.lit("[tool:end] "), "event_type")).when(k == 2, "[llm:output] y").when(k == 3, F.when(big, "[orchestration] Starting").otherwise("[orchestration] completed")).when(k == 4, F.when(big, "[structured_output] success").otherwise("[structured_output] no")).otherwise("[other]")
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))) == 1
    failed = F.col("event_type") == "error"
    rows = e.withColumn("last", last).select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.when(~F.col("last"), "log").when(failed, "error").otherwise("end").alias("kind"), F.when(~F.col("last"), S.shown_log(log)).when(failed, "boom").alias("message"))
    out = storage.new_folder(spark, "event-lines")
    state.run_available(state.progress_events(_arriving(rows, "stream_id", "seq")), state.event_sink(out), storage.new_folder(spark, "checkpoint"))
    return state.written(spark, out, "stream_id long, seq long, value string").drop("batch")


@query("""WITH x AS (SELECT 1), e AS (SELECT user_id::VARCHAR AS workspace, event_id AS seq, event_type AS t, ts, row_number() OVER w - 1 AS k, 'breadcrumbs_' || substr(md5(user_id || '#' || event_id), 1, 12) AS id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, ts - lag(ts) OVER w <= INTERVAL 6 HOURS AS near, lag(id) OVER w AS before, lag(t) OVER w AS t1, lag(t, 2) OVER w AS t2 FROM e WINDOW w AS (PARTITION BY workspace ORDER BY seq)),
f AS (SELECT *, k % 3 = 0 OR (near AND (k % 3 = 1 OR lag(near) OVER (PARTITION BY workspace ORDER BY seq))) AS good FROM g)
SELECT workspace, seq, CASE WHEN good THEN id END AS cache_id, CASE WHEN good THEN CASE k % 3 WHEN 0 THEN t WHEN 1 THEN t1 || '>' || t ELSE t2 || '>' || t1 || '>' || t END END AS crumbs, CASE WHEN NOT good THEN 'Cache ' || before || ' not found or expired' END AS error FROM f""")
def pushed_breadcrumbs(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = A.table(spark, d, "events").withColumns({"k": F.row_number().over(w) - 1, "last": F.lag("event_id").over(w)})
    onto = F.when(F.col("k") % 3 > 0, F.concat(F.lit("breadcrumbs_"), F.substring(F.md5(F.concat_ws("#", "user_id", "last")), 1, 12)))
    rows = e.select(F.col("user_id").cast("string").alias("workspace"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), onto.alias("cache_id"), F.to_json(F.struct(F.col("event_type").alias("title"))).alias("node"))
    out = storage.new_folder(spark, "pushes")
    state.run_available(state.breadcrumb_pushes(_arriving(rows, "workspace", "seq"), 6 * 3600), state._once(out), storage.new_folder(spark, "checkpoint"))
    got = state.written(spark, out, "workspace string, seq long, cache_id string, crumbs string, error string")
    titles = F.transform(F.from_json("crumbs", "array<struct<title:string>>"), lambda c: c["title"])
    return got.select("workspace", "seq", "cache_id", F.array_join(titles, ">").alias("crumbs"), "error")


@query("SELECT user_id AS stream_id, event_type AS message, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id)) AS place FROM events GROUP BY user_id, event_type")
def moved_to_end(spark, d):
    rows = A.table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("message"))
    out = storage.new_folder(spark, "arrivals")
    state.run_available(state.last_arrivals(_arriving(rows, "stream_id", "seq")), state._once(out), storage.new_folder(spark, "checkpoint"), "update")
    last = state.last_arrivals(state.written(spark, out, "stream_id long, message string, last_seen long").withColumn("seq", F.col("last_seen")))
    return last.select("stream_id", "message", F.row_number().over(Window.partitionBy("stream_id").orderBy("last_seen")).cast("long").alias("place"))


@query("""WITH x AS (SELECT 1), c AS (SELECT *, 'seg-' || c_mktsegment AS w FROM customer WHERE c_mktsegment <> 'AUTOMOBILE')
SELECT w AS workspace_id, 'profiles' AS name, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM c GROUP BY w UNION ALL SELECT w, 'nodes', count(DISTINCT c_nationkey), sum(DISTINCT c_nationkey)::BIGINT FROM c GROUP BY w
UNION ALL SELECT w, 'edges', count(*), sum(o_orderkey)::BIGINT FROM c JOIN orders ON o_custkey = c_custkey GROUP BY w UNION ALL SELECT w, 'workflows', count(*), sum(c_custkey)::BIGINT FROM c WHERE c_acctbal > 0 GROUP BY w""")
def workspace_lifecycle(spark, d):
    """A workspace for each market segment, made twice, saved in two commits, one deleted; what is left of the four tables."""
    claims, data = storage.new_folder(spark, "claims"), storage.new_folder(spark, "workspaces")
    customer, orders = A.table(spark, d, "customer"), A.table(spark, d, "orders")
    segments = [r[0] for r in customer.select("c_mktsegment").distinct().collect()]  # a few market segments
    for s in segments:
        mine = customer.filter(F.col("c_mktsegment") == s)
        _, made = catalog.get_or_create(spark, claims, "seg", s)
        _, again = catalog.get_or_create(spark, claims, "seg", s, "other")
        if not made or again:
            raise RuntimeError("a claim was given twice")
        commits.save({"profiles": mine.select(F.col("c_custkey").alias("key")), "nodes": mine.select(F.col("c_nationkey").cast("long").alias("key")).distinct()}, data, f"seg-{s}")
        edges = orders.join(mine, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("key"))
        commits.save({"edges": edges, "workflows": mine.filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"))}, data, f"seg-{s}")
    catalog.delete_workspace(spark, claims, data, "seg", "AUTOMOBILE")
    out, there = None, catalog.list_workspaces(spark, claims).select("workspace_id")
    for name in ("profiles", "nodes", "edges", "workflows"):
        part = commits.everywhere(spark, data, name).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys")).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.join(there, "workspace_id").select("workspace_id", "name", "n", "keys")


@query("""WITH x AS (SELECT 1), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT event_type AS component_id, user_id, event_id FROM r WHERE r = 1 AND event_type <> 'signup' AND NOT (event_type = 'click' AND user_id = 7) AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""")
def response_cache(spark, d):
    """All events saved as responses in two saves, some cleared, expired ones swept; what the cache holds then."""
    e = A.table(spark, d, "events").select(F.col("event_type").alias("component_id"), F.array(F.col("user_id").cast("string")).alias("crumbs"), F.col("ts").alias("saved"), F.to_json(F.struct("user_id", "event_id")).alias("body"))
    lo, hi = e.agg(F.min("saved"), F.max("saved")).first()
    cache = ResponseCache(spark, storage.new_folder(spark, "responses"))
    if hi is not None:
        middle = F.lit(lo + (hi - lo) / 2)
        cache.save(e.filter(F.col("saved") < middle))
        cache.save(e.filter(F.col("saved") >= middle))
    cache.clear("signup")
    cache.clear("click", F.array(F.lit("7")))
    cache.clear_expired(F.lit(hi))
    body = F.from_json("body", "user_id long, event_id long")
    return cache.entries(F.lit(hi)).select("component_id", body["user_id"].alias("user_id"), body["event_id"].alias("event_id"))
