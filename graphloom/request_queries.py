"""Queries of requests, prompts, dumps and first-seen lists, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import catalog, commits, documents, link, lookup, requests, storage, workflows
from graphloom.plans import adapter as A
from graphloom.registry import _FILES, _LAYERS, _components, _profiles, query


@query("SELECT user_id, list_transform(list_sort(list({'p': p, 't': event_type})), lambda x: x.t)::VARCHAR AS seen FROM (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY ALL) GROUP BY user_id")
def first_seen_types(spark, d):
    got = link.first_seen(A.table(spark, d, "events"), ["user_id"], "event_type", "event_id")
    return got.select("user_id", F.concat(F.lit("["), F.array_join("event_type", ", "), F.lit("]")).alias("seen"))


@query("""SELECT p_partkey, 'Describe what this ' || ['registry or factory', 'workflow or orchestrator', 'service interface'][k + 1] || ' means for the business.' || chr(10) || chr(10) || 'Component: ' || p_name || chr(10) || chr(10) || 'Findings:' || chr(10) || 'Classes: ' || p_type ||
CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || 'Context: Focusing on class: ' || p_brand || CASE WHEN p_size % 4 = 0 THEN chr(10) || 'more' ELSE '' END WHEN p_size % 4 = 1 THEN chr(10) || chr(10) || 'Context: more' ELSE '' END || chr(10) || chr(10) || 'Answer with one JSON object of these fields only:' || chr(10) ||
'1. semantic_role: one of ' || ['REPOSITORY, FACTORY, GATEWAY, MEDIATOR, ORCHESTRATOR', 'ORCHESTRATOR, PROCESSOR, DISPATCHER, VALIDATOR, TRANSFORMER', 'GATEWAY, ADAPTER, MEDIATOR, PROCESSOR, SINK'][k + 1] || chr(10) || '2. business_context: what it does for the business, in a sentence or two' || chr(10) || '3. business_significance: why that matters' || chr(10) ||
'4. flow_position: one of ' || ['ENTRY_POINT, PROCESSING, AGGREGATION, STORAGE', 'ENTRY_POINT, VALIDATION, PROCESSING, TRANSFORMATION, OUTPUT', 'ENTRY_POINT, PROCESSING, OUTPUT, ERROR_HANDLING'][k + 1] || chr(10) || '5. risk_level: how bad a failure would be, one of CRITICAL, HIGH, MEDIUM, LOW' || chr(10) || '6. dependencies_description: what it depends on or serves' || chr(10) || '7. impacted_workflows: a list of workflows' AS prompt
FROM (SELECT *, p_size % 3 AS k FROM part)""")
def semantic_prompts(spark, d):
    n = F.col("p_size")
    pattern = F.get(F.array(F.lit("A"), F.lit("b"), F.lit("C")), n % 3)
    prompt = requests.semantic_prompt(pattern, F.col("p_name"), F.concat(F.lit("Classes: "), "p_type"), F.when(n % 2 == 0, F.col("p_brand")), F.when(n % 4 < 2, "more"))
    return A.table(spark, d, "part").select("p_partkey", prompt.alias("prompt"))


@query("""SELECT p_partkey, '# COMPONENT CONTEXT' || chr(10) || '{"component_card":{"component_id":"' || p_brand || '","module_name":"' || p_name || '","directory":null,"business_signal":null,"leading_landmarks":[{"id":' || p_size || '}],"core_models":[]' || CASE WHEN k = 1 THEN ',"primary_entry_points":[{"r":1}]' ELSE '' END || '},"breadcrumbs":' ||
CASE k WHEN 0 THEN '[]' WHEN 1 THEN '[{"node_key":"a","title":"T","node_type":"class"}]' WHEN 2 THEN '[{"node_key":"a","title":"T","node_type":"class"},{"node_key":"b","title":"U","node_type":"group","metadata":{"action_parameters":{"paths":["x.py","y.py"]}}}]' WHEN 3 THEN '[{"node_key":"c","title":"V","node_type":"topic","target_id":"n"}]' ELSE '[{"node_key":"c","title":"V","node_type":"topic"}]' END || ',"objectives":["' || p_type || '"]}' ||
CASE k WHEN 0 THEN '' ELSE chr(10) || chr(10) || '# CURRENT FOCUS (Drilldown Depth: ' || CASE k WHEN 2 THEN 2 ELSE 1 END || ')' || chr(10) || 'Path: ' || p_name || ' > ' || CASE k WHEN 1 THEN 'T' WHEN 2 THEN 'T > U' ELSE 'V' END || chr(10) || 'Node: ' || CASE k WHEN 1 THEN 'T (type: class)' WHEN 2 THEN 'U (type: group)' ELSE 'V (type: topic)' END || chr(10) ||
  CASE k WHEN 1 THEN 'Inside of a class: extract_subgraph(anchor_node_id="T", max_depth=1).' WHEN 2 THEN 'Group of files: scan these only.' || chr(10) || '  - x.py' || chr(10) || '  - y.py' WHEN 3 THEN 'Node of the graph: extract_subgraph(anchor_node_id="n", max_depth=1).' ELSE 'No target: choose the tool by the node''s type.' END END ||
chr(10) || chr(10) || '# TASK' || chr(10) || 'Phase 1: name the pattern of the component (A registry, B workflow, C interface). Answer with JSON only.' || chr(10) AS request FROM (SELECT *, p_size % 5 AS k FROM part)""")
def component_requests(spark, d):
    k = F.col("p_size") % 5
    entry = F.when(k == 1, F.array(F.struct(F.lit(1).alias("r")))).when(k == 2, F.array().cast("array<struct<r:int>>"))
    card = F.to_json(F.struct(F.col("p_brand").alias("component_id"), F.col("p_name").alias("module_name"), F.array(F.struct(F.col("p_size").alias("id"))).alias("leading_landmarks"), entry.alias("primary_entry_points"), F.lit("left out").alias("more")))
    crumb = lambda key, title, kind, target=None, meta="{}": F.struct(F.lit(key).alias("node_key"), F.lit(title).alias("title"), F.lit(kind).alias("node_type"), F.lit(target).cast("string").alias("target_id"), F.lit(meta).alias("metadata"))
    t = crumb("a", "T", "class")
    crumbs = F.when(k == 0, F.slice(F.array(t), 1, 0)).when(k == 1, F.array(t)).when(k == 2, F.array(t, crumb("b", "U", "group", "", '{"action_parameters":{"paths":["x.py","y.py"]}}'))).when(k == 3, F.array(crumb("c", "V", "topic", "n"))).otherwise(F.array(crumb("c", "V", "topic")))
    return A.table(spark, d, "part").select("p_partkey", requests.component_request(card, crumbs, F.array("p_type")).alias("request"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'id=' || p_brand ELSE 'id=' || p_brand || ',subagent_payload={\"objective\":[\"' || p_type || '\"]}' END AS card FROM part")
def card_payloads(spark, d):
    n = F.col("p_size") % 3
    card = F.to_json(F.struct(F.col("p_brand").alias("id"), F.when(n != 1, "old").alias("subagent_payload")))
    payload = F.when(n == 0, F.when(F.col("p_size") % 2 == 0, "{}")).otherwise(F.to_json(F.struct(F.array("p_type").alias("objective"))))
    got = requests.normal_payload(card, payload)
    return A.table(spark, d, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(got), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("card"))


@query("""WITH x AS (SELECT 1) SELECT 'nodes' AS part, '{"id":"' || id || '","kind":"' || kind || '"}' AS line FROM nodes UNION ALL SELECT 'edges', '{"source":"' || source || '","target":"' || target || '","type":"' || type || '"}' FROM edges
UNION ALL SELECT DISTINCT 'unresolved', '{"id":"' || target || '"}' FROM edges WHERE target NOT IN (SELECT id FROM nodes)""")
def graph_dump(spark, d):
    return requests.graph_dump(A.nodes(spark, d).select("id", "kind"), A.edges(spark, d).select("source", "target", "type"))


# ---------------------------------------------------------------- messages


_TURNS = "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'tool' ELSE 'ai' END ELSE 'system' END AS type, coalesce(text, '') AS text FROM conversations"


def _messages(spark, d):
    role, text = F.col("role"), F.coalesce("text", F.lit(""))
    kind = F.when(role == "user", "human").when(role == "assistant", F.when(F.col("turn") % 4 == 1, "tool").otherwise("ai")).otherwise("system")
    listed = F.to_json(F.array(text, F.lit('{"type":"image"}')))
    return A.table(spark, d, "conversations").select("conv_id", "turn", kind.alias("type"), F.lit(None).cast("string").alias("name"), F.when(F.col("turn") % 3 == 2, listed).otherwise(text).alias("content"), F.lit('[{"name":"x"}]').alias("tool_calls"), F.concat(F.lit("call-"), "turn").alias("tool_call_id"))


@query(f"""WITH x AS (SELECT 1), m AS ({_TURNS}) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS index, CASE type WHEN 'human' THEN 'HumanMessage' WHEN 'ai' THEN 'AIMessage' WHEN 'tool' THEN 'ToolMessage' ELSE 'SystemMessage' END AS type,
text AS content, CASE WHEN type = 'ai' THEN '[{{"name":"x"}}]' END AS tool_calls, CASE WHEN type = 'tool' THEN 'call-' || turn END AS tool_call_id FROM m""")
def message_serialisation(spark, d):
    return workflows.message_rows(_messages(spark, d), "conv_id", "turn")


@query(f"""WITH x AS (SELECT 1), m AS ({_TURNS}), t AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE type = 'human') AS request, count(*) FILTER (WHERE type = 'human') AS n, count(*) FILTER (WHERE type = 'tool') AS tools FROM m GROUP BY conv_id)
SELECT conv_id, 1 AS place, 'system' AS type, 'Drill.' AS content FROM t UNION ALL SELECT conv_id, 2, 'human', request FROM t WHERE n > 0 UNION ALL SELECT conv_id, 3, 'human', 'Pattern: generic' || chr(10) || 'Findings of the tools: ' || tools FROM t""")
def message_stacks(spark, d):
    """Each conversation as three messages; of the findings, how many there are."""
    m = _messages(spark, d).withColumn("content", F.when(F.col("type") == "human", workflows.coerced_text(F.col("content"))).otherwise(F.col("content")))
    got = workflows.reduced_messages(m, "conv_id", "turn", F.lit("Drill."), F.lit("generic"))
    results = F.from_json(F.split("content", "\n", 3)[2], "array<struct<tool:string>>")
    short = F.when(F.col("place") == 3, F.concat(F.substring_index("content", "\n", 1), F.lit("\nFindings of the tools: "), F.size(results).cast("string"))).otherwise(F.col("content"))
    return got.select("conv_id", "place", "type", short.alias("content"))


# ---------------------------------------------------------------- lookups, plans, workflows, layers


@query(f"""WITH x AS (SELECT 1), {_FILES}, o AS (SELECT min('python::' || f || '::load_' || k) AS id FROM m) SELECT 0 AS position, 'Size' || regexp_extract(id, '([0-9]+)$', 1) AS call FROM o UNION ALL SELECT 1, 'fetch.rows'""")
def profile_calls(spark, d):
    p = _profiles(spark, d)
    return lookup.calls_of(p, p.filter("kind = 'function'").agg(F.min("id")).first()[0] or "")


@query("WITH x AS (SELECT 1) SELECT id FROM profiles WHERE id LIKE 'part::%' ORDER BY id LIMIT 50")
def entry_candidates(spark, d):
    return lookup.entry_candidates(A.profiles(spark, d), limit=50)


@query("""WITH x AS (SELECT 1), c AS (SELECT c_mktsegment AS g, c_name AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS most FROM customer)
SELECT c_mktsegment AS "group", CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_custkey::VARCHAR ELSE 'none' END AS choice, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN (SELECT id FROM c WHERE c.g = c_mktsegment AND c.n = c_custkey) END AS component_id FROM customer""")
def picked_components(spark, d):
    """For every customer a choice among its segment: by name, by place, or none."""
    c, k = A.table(spark, d, "customer"), F.col("c_custkey") % 3
    cards = c.select(F.col("c_mktsegment").alias("group"), F.col("c_name").alias("component_id"), F.col("c_custkey").alias("position"))
    return lookup.picked_component(cards, c.select(F.col("c_mktsegment").alias("group"), F.when(k == 0, F.col("c_name")).when(k == 1, F.col("c_custkey").cast("string")).otherwise("none").alias("choice")))


@query("SELECT c_name AS name, CASE WHEN c_custkey % 4 > 0 THEN '{\"k\":' || c_custkey || '}' END AS plan FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'none', NULL FROM region WHERE false")
def stored_plans(spark, d):
    """Plans of all customers, then of every second one in their place; some aren't JSON."""
    path, k = storage.new_folder(spark, "plans"), F.col("c_custkey")
    plans = A.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.when(k % 4 > 0, F.concat(F.lit('{"k":'), k, F.lit("}"))).otherwise("{broken").alias("plan"), "c_custkey")
    catalog.write_plan(plans, path, "w")
    catalog.write_plan(plans.filter(k % 2 == 0), path, "w")
    return catalog.load_plan(spark, path, "w").unionByName(catalog.load_plan(spark, path, "none"))


@query("SELECT o_orderkey AS entry, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE o_orderpriority END AS workflow FROM orders")
def saved_workflows(spark, d):
    path, o = storage.new_folder(spark, "workflows"), A.table(spark, d, "orders")
    catalog.save_workflows(o.select(F.col("o_orderkey").alias("entry"), F.col("o_orderpriority").alias("workflow")), path, "w")
    catalog.save_workflows(o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("entry"), F.lit("new").alias("workflow")), path, "w")
    return commits.load(spark, path, "w", "workflows")


@query("WITH x AS (SELECT 1), g AS (SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) ELSE 'Other' END AS label, count(*) AS n FROM customer GROUP BY 1) SELECT label, n, (SELECT count(*) FROM g) AS layers, (SELECT sum(n) FROM g)::BIGINT AS components FROM g")
def labelled_layers(spark, d):
    got = documents.group_by_layer(_components(spark, d), _LAYERS)
    return got.select(documents.layer_label(F.col("layer"), F.col("rank"), len(_LAYERS)).alias("label"), "n").crossJoin(F.broadcast(documents.layer_totals(got)))  # one row
