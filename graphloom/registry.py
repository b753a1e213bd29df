"""Queries of the core engine by name, with the equivalent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import documents, graph, link, storage, text
from graphloom.plans import adapter as A

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = ("WITH RECURSIVE " + A.SQL.strip() + ", " + sql.strip()[5:]) if sql.strip().startswith("WITH ") else sql
        return f

    return add


_RANK = """WITH calls AS (SELECT source, target, sum(greatest(weight, 0)) AS w FROM edges WHERE type = 'CALLS' GROUP BY ALL),
ids AS (SELECT id FROM nodes UNION SELECT source FROM calls UNION SELECT target FROM calls), n AS (SELECT count(*)::DOUBLE AS n FROM ids),
outs AS (SELECT source, sum(w) AS t FROM calls GROUP BY source), step AS (SELECT c.source, c.target, w / t AS p FROM calls c JOIN outs o ON c.source = o.source),
dang AS (SELECT id FROM ids WHERE id NOT IN (SELECT source FROM outs)),
pr AS (SELECT 0 AS k, id, 1.0 / (SELECT n FROM n) AS score, NULL::DOUBLE AS old FROM ids
  UNION ALL SELECT d.k + 1, i.id, 0.15 / (SELECT n FROM n) + 0.85 * (coalesce(g.got, 0) + d.loose / (SELECT n FROM n)), o.score FROM ids i
    CROSS JOIN (SELECT any_value(k) AS k, coalesce(sum(score) FILTER (WHERE id IN (SELECT id FROM dang)), 0) AS loose, sum(abs(score - old)) AS change FROM pr) d
    JOIN pr o ON o.id = i.id LEFT JOIN (SELECT s.target, sum(s.p * pr.score) AS got FROM step s JOIN pr ON pr.id = s.source GROUP BY s.target) g ON g.target = i.id WHERE d.k < 100 AND (d.change IS NULL OR d.change >= 1e-6)),
mult AS (SELECT * FROM (VALUES ('service', 4.0), ('integration', 0.5), ('model', 2.2), ('infrastructure', 0.4), ('utility', 0.35), ('external', 0.0)) m(c, m)),
raw AS (SELECT pr.id, pr.score * m.m AS s, nodes.label, nodes.kind, nodes.category, nodes.file_path FROM pr LEFT JOIN nodes USING (id) JOIN mult m ON m.c = coalesce(nodes.category, 'external') WHERE pr.k = (SELECT max(k) FROM pr)),
ranked AS (SELECT id, s / (SELECT sum(s) FROM raw WHERE s > 0) AS score, label, kind, category, file_path FROM raw WHERE s > 0)
"""

_ranks: dict[tuple, DataFrame] = {}


def _ranked(spark, d) -> DataFrame:
    """The ranked nodes of the trade graph, to convergence; settled once for a session and a state of the tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(d)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    key = (spark.sparkContext.applicationId, d, tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))
    if key not in _ranks:
        n = storage.settle(A.nodes(spark, d))
        _ranks[key] = storage.settle(graph.adjusted(graph.pagerank(n, A.edges(spark, d)), n))
    return _ranks[key]


@query(_RANK + "SELECT id, round(score, 9) AS score, label, kind, category, file_path FROM ranked ORDER BY ranked.score DESC, id LIMIT 10")
def rank_nodes(spark, d):
    top = _ranked(spark, d).orderBy(F.desc("score"), "id").limit(10)
    return top.select("id", F.round("score", 9).alias("score"), "label", "kind", "category", "file_path")


_DIRECTORIES = """, placed AS (SELECT *, split_part(file_path, '/', 1) AS directory FROM ranked WHERE len(string_split(file_path, '/')) > 1),
best AS (SELECT directory, string_agg(id, ',' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY round(score, 9) DESC, id) AS r FROM placed) WHERE r <= 5 GROUP BY directory),
kinds AS (SELECT directory, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT directory, kind, count(*) AS n FROM placed GROUP BY ALL) GROUP BY directory),
categories AS (SELECT directory, string_agg(category || '=' || n, ',' ORDER BY category) AS categories FROM (SELECT directory, category, count(*) AS n FROM placed GROUP BY ALL) GROUP BY directory)
SELECT directory, round(avg(score), 9) AS avg_score, round(sum(score), 9) AS total_score, count(*) AS n, any_value(kinds) AS kinds, any_value(categories) AS categories, any_value(top) AS top
FROM placed JOIN best USING (directory) JOIN kinds USING (directory) JOIN categories USING (directory) GROUP BY directory ORDER BY avg_score DESC, directory LIMIT 20"""


def _directories(got: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias(c)
    return got.select("directory", "avg_score", "total_score", "n", text("kinds"), text("categories"), "top")


@query(_RANK + _DIRECTORIES)
def directory_components(spark, d):
    return _directories(graph.directory_components(_ranked(spark, d)))


@query(_RANK + _DIRECTORIES)
def nested_directory_components(spark, d):
    """The same graph two folders deeper: what all paths share isn't a directory."""
    return _directories(graph.directory_components(_ranked(spark, d).withColumn("file_path", F.concat(F.lit("src/app/"), "file_path"))))


@query("WITH x AS (SELECT 1) SELECT source, target, sum(greatest(weight, 0)) AS weight FROM edges WHERE type = 'CALLS' GROUP BY source, target")
def weighted_digraph(spark, d):
    return graph.weighted(A.edges(spark, d))


@query("WITH x AS (SELECT 1) SELECT type, count(*) AS edges, round(sum(weight), 6) AS weight FROM edges GROUP BY type")
def edge_type_histogram(spark, d):
    return A.edges(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


@query("WITH x AS (SELECT 1) SELECT split_part(file_path, '/', 1) AS directory, kind, category, count(*) AS n FROM nodes GROUP BY ALL")
def kind_histogram(spark, d):
    return A.nodes(spark, d).groupBy(F.split("file_path", "/")[0].alias("directory"), "kind", "category").agg(F.count(F.lit(1)).alias("n"))


@query("WITH x AS (SELECT 1) SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def graph_counts(spark, d):
    return A.nodes(spark, d).agg(F.count(F.lit(1)).alias("nodes")).crossJoin(A.edges(spark, d).agg(F.count(F.lit(1)).alias("edges")))  # one row each


@query("WITH x AS (SELECT 1) SELECT target AS neighbor, type FROM edges WHERE source = 'customer::1'")
def neighbors_by_type(spark, d):
    return graph.neighbors(A.edges(spark, d), "customer::1")


@query("WITH x AS (SELECT 1) SELECT source AS neighbor, list_sort(list(DISTINCT type))::VARCHAR AS types, sum(weight) AS weight FROM edges WHERE target = 'part::1' GROUP BY source")
def edge_bundles(spark, d):
    got = graph.edge_bundles(A.edges(spark, d), "part::1", "in")
    return got.withColumn("types", F.concat(F.lit("["), F.array_join("types", ", "), F.lit("]")))


@query("""WITH walk AS (SELECT 'nation::1' AS start, 'nation::1' AS "at", ['nation::1'] AS path, 0 AS depth
  UNION ALL SELECT w.start, e.target, list_append(w.path, e.target), w.depth + 1 FROM walk w JOIN edges e ON e.source = w."at" AND e.type IN ('CONTAINS', 'CALLS', 'USES') WHERE w.depth < 3 AND NOT list_contains(w.path, e.target)),
found AS (SELECT start, "at" AS "end", depth, array_to_string(path, '>') AS path FROM walk WHERE "at" = 'supplier::1')
SELECT start, "end", depth, path, NULL AS error FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, path) AS r FROM found) WHERE r <= 200 UNION ALL SELECT 'none::1', NULL, NULL, NULL, 'Node does not exist.'""")
def find_paths(spark, d):
    got = graph.find_paths(A.edges(spark, d), ["nation::1", "none::1"], ["supplier::1"], ("CONTAINS", "CALLS", "USES"), max_depth=3, max_paths=200, nodes=A.nodes(spark, d))
    return got.select("start", "end", "depth", F.array_join("path", ">").alias("path"), "error")


@query("""WITH one AS (SELECT CASE WHEN source = 'region::0' THEN target ELSE source END AS id FROM edges WHERE source = 'region::0' OR target = 'region::0'),
a AS (SELECT 'region::0' AS id, 0 AS depth UNION ALL (SELECT DISTINCT id, 1 FROM one ORDER BY id LIMIT 99)),
two AS (SELECT DISTINCT CASE WHEN e.source IN (SELECT id FROM a WHERE depth = 1) THEN target ELSE source END AS id FROM edges e WHERE source IN (SELECT id FROM a WHERE depth = 1) OR target IN (SELECT id FROM a WHERE depth = 1))
SELECT id, depth FROM a UNION ALL (SELECT id, 2 FROM two WHERE id NOT IN (SELECT id FROM a) ORDER BY id LIMIT (SELECT 100 - count(*) FROM a))""")
def extract_subgraph(spark, d):
    return graph.expand(A.edges(spark, d), "region::0", 2, 100)[0]


@query("WITH x AS (SELECT 1) SELECT target AS base, count(*) AS children FROM edges WHERE type = 'INHERITS_FROM' GROUP BY target")
def base_in_degree(spark, d):
    return graph.of_types(A.edges(spark, d), ("INHERITS_FROM",)).groupBy(F.col("target").alias("base")).agg(F.count(F.lit(1)).alias("children"))


@query("WITH c AS (SELECT target, count(*) AS n FROM edges WHERE type = 'INHERITS_FROM' GROUP BY target), b AS (SELECT DISTINCT 'brand::' || p_brand AS id FROM part) SELECT id, coalesce(n, 0) AS inheritance_depth, CASE WHEN coalesce(n, 0) >= 2 THEN 'Plugin Architecture' ELSE 'Class Hierarchy' END AS pattern FROM b LEFT JOIN c ON id = target ORDER BY coalesce(n, 0) DESC, id LIMIT 1")
def dominant_base(spark, d):
    brands = A.table(spark, d, "part").select("p_brand").distinct().select(F.concat(F.lit("brand::"), "p_brand").alias("id"), F.col("p_brand").alias("label"), F.lit("class").alias("kind"), F.lit("").alias("category"), F.lit("parts").alias("file_path"))
    return graph.dominant_base(brands, A.edges(spark, d))


@query("WITH x AS (SELECT 1) SELECT e.source, e.target, e.weight FROM edges e WHERE type = 'CALLS' AND NOT EXISTS (SELECT 1 FROM nodes WHERE id = e.target)")
def unresolved_calls(spark, d):
    return graph.of_types(A.edges(spark, d), ("CALLS",)).join(A.nodes(spark, d), F.col("target") == F.col("id"), "left_anti").select("source", "target", "weight")


@query("WITH x AS (SELECT 1) SELECT id, kind, coalesce(nullif(category, ''), nullif(kind, ''), 'unknown') AS category FROM nodes WHERE upper(label) LIKE '%1%' AND kind IN ('part', 'supplier')")
def node_snapshot(spark, d):
    n = A.nodes(spark, d).filter(F.upper("label").contains("1") & F.col("kind").isin("part", "supplier"))
    return n.select("id", "kind", S.category(F.col("category"), F.col("kind")).alias("category"))


@query("WITH x AS (SELECT 1) SELECT path, CASE WHEN path LIKE '%/en/%' THEN '**/en/*.txt' ELSE 'src1/**' END AS pattern, printf('%.1f', strlen(content) / 1024.0) || ' KB' AS size FROM files WHERE regexp_matches(path, '^(?:.*/)?en/[^/]*\\.txt$') OR regexp_matches(path, '^src1/.*$') ORDER BY path LIMIT 200")
def scan_files(spark, d):
    return text.scan(A.files(spark, d), ["**/en/*.txt", "src1/**"], 200)


@query("""WITH s AS (SELECT path, regexp_split_to_array(content, '\\r\\n?|\\n') AS a FROM files), l AS (SELECT path, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM s), x AS (SELECT path, a, unnest(range(1, len(a) + 1))::INT AS line, unnest(a) AS text FROM l)
SELECT path, line::INT AS line, text, array_to_string(list_transform(range(greatest(1, line - 2), least(len(a), line + 2) + 1), lambda j: lpad(j::VARCHAR, greatest(4, length(j::VARCHAR))::INT, ' ') || CASE WHEN j = line THEN ' >>> ' ELSE '     ' END || regexp_replace(a[j], '\\s+$', '')), chr(10)) AS context
FROM x WHERE regexp_matches(text, 'idiot|moron[s]?') ORDER BY path, line LIMIT 30""")
def search_codebase(spark, d):
    return text.search(A.files(spark, d), "idiot|moron[s]?")


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part) SELECT p_partkey, list_transform(l, lambda w: upper(w[1]) || lower(w[2:]))::VARCHAR AS words FROM p""")
def title_words(spark, d):
    p = A.table(spark, d, "part")
    words = F.split(S.title_case(F.regexp_replace("p_name", " ", "-")), " ")
    return p.select("p_partkey", F.concat(F.lit("["), F.array_join(words, ", "), F.lit("]")).alias("words"))


@query("SELECT page_id, substr(md5(array_to_string(string_split(url, '/'), '→')), 1, 12) AS key FROM pages")
def breadcrumb_keys(spark, d):
    return A.table(spark, d, "pages").select("page_id", S.breadcrumb_key(F.split("url", "/")).alias("key"))


@query("SELECT event_id, CASE WHEN length(props) > 6 THEN substr(props, 1, 6) || '...' ELSE props END AS short, (props::JSON->>'k')::BIGINT AS k FROM events")
def event_payload(spark, d):
    return A.table(spark, d, "events").select("event_id", S.shorten(F.col("props"), 6, "...").alias("short"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR p IS DISTINCT FROM event_type")
def progress_changes(spark, d):
    return documents.changed(A.table(spark, d, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def last_messages(spark, d):
    return text.last_of_each(A.table(spark, d, "events"), "user_id", "event_id", 5).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, max(event_id) AS last_seen FROM events GROUP BY ALL")
def latest_per_message(spark, d):
    return A.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_seen"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def live_entries(spark, d):
    e = A.table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return e.crossJoin(F.broadcast(now)).filter(~S.expired(F.col("ts"), F.col("now"))).select("event_id")


@query("WITH x AS (SELECT 1), c AS (SELECT conv_id, coalesce(role, '') = 'user' AS mine, coalesce(length(text) // 4, 0) AS n FROM conversations) SELECT conv_id, sum(CASE WHEN mine THEN n ELSE 0 END)::BIGINT AS prompt, sum(CASE WHEN mine THEN 0 ELSE n END)::BIGINT AS completion, sum(n)::BIGINT AS total, round((sum(CASE WHEN mine THEN n ELSE 0 END) * 0.075::DOUBLE + sum(CASE WHEN mine THEN 0 ELSE n END) * 0.30::DOUBLE) / 1e6, 6)::DOUBLE AS cost FROM c GROUP BY conv_id")
def token_usage(spark, d):
    c = A.table(spark, d, "conversations").withColumns({"n": F.coalesce(S.token_estimate(F.col("text")), F.lit(0)), "mine": F.coalesce(F.col("role") == "user", F.lit(False))})
    c = c.withColumns({"p": F.when(F.col("mine"), F.col("n")).otherwise(0), "c": F.when(F.col("mine"), 0).otherwise(F.col("n"))})
    return documents.usage_totals(c, "conv_id", "p", "c")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, role AS type, text FROM conversations")
def message_log(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return A.table(spark, d, "conversations").select("conv_id", F.row_number().over(w).cast("long").alias("idx"), F.col("role").alias("type"), "text")


@query("SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_human, count(*) AS messages FROM conversations GROUP BY conv_id")
def message_reduction(spark, d):
    c = A.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first_human"), F.count(F.lit(1)).alias("messages"))


_LAYERS = ["BUILDING", "AUTOMOBILE", "MACHINERY"]


def _components(spark, d) -> DataFrame:
    return A.table(spark, d, "customer").select(F.col("c_mktsegment").alias("layer"), F.col("c_name").alias("component"))


@query("SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN c_mktsegment ELSE 'Other' END AS layer, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS rank, string_agg(c_name, ',' ORDER BY c_name) AS components, count(*) AS n FROM customer GROUP BY 1, 2")
def group_by_layer(spark, d):
    return documents.group_by_layer(_components(spark, d), _LAYERS)


@query("WITH c AS (SELECT c_name AS component, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS rank FROM customer), p AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY component) - 1 AS i FROM c), t AS (SELECT rank, coalesce(sum(60 + (max(i) // 3 + 1) * 220 + 180) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM p GROUP BY rank) SELECT component, rank, (40 + i % 3 * 400)::BIGINT AS x, (top + 60 + i // 3 * 220)::BIGINT AS y FROM p JOIN t USING (rank)")
def grid_layout(spark, d):
    rank = F.array_position(F.array(*[F.lit(x) for x in _LAYERS]), F.col("layer"))
    return documents.grid(_components(spark, d).select("component", F.when(rank > 0, rank - 1).otherwise(3).cast("int").alias("rank")))


@query("SELECT o_custkey AS source, o_orderkey AS target, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 - (count(*) OVER (PARTITION BY o_custkey) - 1) / 2) * 20)::DOUBLE AS \"offset\" FROM orders")
def edge_offsets(spark, d):
    return documents.edge_offsets(A.table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target")))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN lower(replace(trim(p_brand), ' ', '_')) IN ('brand#11', 'brand#12') THEN lower(replace(trim(p_brand), ' ', '_')) END AS role FROM part")
def lenient_enums(spark, d):
    return A.table(spark, d, "part").select("p_partkey", F.when(F.col("p_type").contains("STEEL"), "steel").otherwise(S.enum_or_null(F.col("p_brand"), ["brand#11", "brand#12"])).alias("role"))


@query("SELECT o.o_orderkey, CASE WHEN c.c_custkey IS NOT NULL THEN o.o_custkey END AS target FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0")
def validated_targets(spark, d):
    good = A.table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey")
    return A.table(spark, d, "orders").join(good, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.when(F.col("c_custkey").isNotNull(), F.col("o_custkey")).alias("target"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT o_orderkey, o_custkey, 'X' FROM orders WHERE o_orderstatus = 'O'")
def upsert_rows(spark, d):
    old = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = A.table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"))
    return storage.upsert(old, new, ["o_orderkey"])


@query("SELECT page_id, '/' || array_to_string(string_split(url, '/')[4:], '/') AS route, lower(split_part(split_part(url, '://', 2), '/', 1)) AS host FROM pages WHERE contains(lower(url), 'en') ORDER BY route, page_id LIMIT 200")
def routes(spark, d):
    p = A.table(spark, d, "pages").filter(F.lower("url").contains("en"))
    parts = F.split("url", "/")
    route = F.concat(F.lit("/"), F.array_join(F.slice(parts, 4, F.size(parts)), "/"))
    return p.select("page_id", route.alias("route"), F.lower(F.split(F.split("url", "://")[1], "/")[0]).alias("host")).orderBy("route", "page_id").limit(200)


def _profiles(spark, d) -> DataFrame:
    """Source files written from the trade tables: one module per brand, one class per part size, methods that call one another."""
    from graphloom.sources.python_source import extract

    return storage.settle(extract(_sources(spark, d)))


def _sources(spark, d) -> DataFrame:
    p = A.table(spark, d, "part").withColumn("m", F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")))
    body = F.concat(F.lit("class Size"), F.col("p_size"), F.lit(":\n    def run(self, x: int):\n        return load_"), F.col("p_size"), F.lit("(x)\n\n\ndef load_"), F.col("p_size"), F.lit("(x):\n    return Size"), F.col("p_size"), F.lit("().run(fetch.rows(x))\n"))
    one = p.select("m", "p_size", body.alias("b")).distinct()
    return one.groupBy("m").agg(F.array_join(F.sort_array(F.collect_set("b")), "\n\n").alias("content")).select(F.concat(F.lit("api/"), "m", F.lit(".py")).alias("path"), "content")


@query("""WITH m AS (SELECT DISTINCT p_size AS k, 'api/' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) || '.py' AS f FROM part)
SELECT 'python::file::' || f AS id, 'file' AS kind, NULL AS parent_id, '' AS parameters, count(*) * 2 AS children FROM m GROUP BY f
UNION ALL SELECT 'python::' || f || '::Size' || k, 'class', 'python::file::' || f, '', 1 FROM m
UNION ALL SELECT 'python::' || f || '::Size' || k || '::run', 'method', 'python::' || f || '::Size' || k, 'self,x', 0 FROM m
UNION ALL SELECT 'python::' || f || '::load_' || k, 'function', 'python::file::' || f, 'x', 0 FROM m""")
def extract_profiles(spark, d):
    return _profiles(spark, d).select("id", "kind", "parent_id", F.coalesce(F.array_join("parameters", ","), F.lit("")).alias("parameters"), F.size("children").cast("long").alias("children"))


_FILES = "m AS (SELECT DISTINCT p_size AS k, 'api/' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) || '.py' AS f FROM part)"


@query(f"""WITH {_FILES}, pairs AS (SELECT a.f, a.k, b.f AS g FROM m a JOIN m b USING (k))
SELECT 'python::file::' || f AS source, 'python::' || f || '::Size' || k AS target, 'CONTAINS' AS type, true AS resolved FROM m
UNION ALL SELECT 'python::file::' || f, 'python::' || f || '::load_' || k, 'CONTAINS', true FROM m
UNION ALL SELECT 'python::' || f || '::Size' || k, 'python::' || f || '::Size' || k || '::run', 'CONTAINS', true FROM m
UNION ALL SELECT 'python::' || f || '::Size' || k || '::run', 'python::' || g || '::load_' || k, 'CALLS', true FROM pairs
UNION ALL SELECT 'python::' || f || '::load_' || k, 'python::' || g || '::Size' || k, 'USES', true FROM pairs
UNION ALL SELECT 'python::' || f || '::load_' || k, 'python::' || g || '::Size' || k || '::run', 'CALLS', true FROM pairs
UNION ALL SELECT 'python::' || f || '::load_' || k, 'external::fetch.rows', 'CALLS', false FROM m""")
def link_graph(spark, d):
    return link.build(_profiles(spark, d))[1].select("source", "target", "type", "resolved")


@query("""WITH t AS (SELECT DISTINCT target FROM edges WHERE source = 'customer::1' AND type = 'CALLS')
SELECT 0::BIGINT AS position, 'customer::1' AS id UNION ALL SELECT row_number() OVER (ORDER BY target)::BIGINT, target FROM t""")
def trace_workflow(spark, d):
    return graph.trace(A.edges(spark, d), "customer::1", 3)


@query()
def core_models(spark, d):
    from graphloom.sources.python_source import core_models as models

    return models(_profiles(spark, d), ("api",), 100)


from graphloom import document_queries, request_queries, source_queries, state_queries  # noqa: E402, F401 - their queries are added to these


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
