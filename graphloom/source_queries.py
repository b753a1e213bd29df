"""Queries of source files, categories, noise, entry points and contexts over the given tables, with SQL whose word lists are written out here, apart from the library's."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import link, lookup, storage, workflows
from graphloom.plans import adapter as A
from graphloom.registry import _sources, query
from graphloom.sources import files as sources
from graphloom.sources import python_source as P

_BRAND = "lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g'))"


@query(f"""WITH x AS (SELECT 1), m AS (SELECT DISTINCT p_size AS k, 'api/' || {_BRAND} || '.py' AS f FROM part)
SELECT 'python::file::' || f AS id, 'file' AS kind, NULL AS parent_id, f AS file_path FROM m GROUP BY f
UNION ALL SELECT 'python::' || f || '::Size' || k, 'class', 'python::file::' || f, f FROM m
UNION ALL SELECT 'python::' || f || '::Size' || k || '::run', 'method', 'python::' || f || '::Size' || k, f FROM m
UNION ALL SELECT 'python::' || f || '::load_' || k, 'function', 'python::file::' || f, f FROM m
UNION ALL SELECT DISTINCT 'text::file::notes/' || replace(f, '.py', '.md'), 'file', NULL, 'notes/' || replace(f, '.py', '.md') FROM m""")
def read_sources(spark, d):
    """Files written from the parts, in kept folders and, once more, in ignored ones and with a suffix without handler; read back by the source, each suffix by its handler."""
    root = storage.new_folder(spark, "sources")
    py = _sources(spark, d)
    under = lambda folder, suffix: py.select(F.concat(F.lit(folder), F.regexp_replace("path", r"\.py$", suffix)).alias("path"), "content")
    every = py.unionByName(under("notes/", ".md")).unionByName(under("lib/node_modules/", ".py")).unionByName(under("build/", ".md")).unionByName(under("notes/", ".rs"))
    sources.write_files(every, root)
    got = sources.read_profiles(spark, root, handlers={".py": P.profiles_of, ".md": sources.text_profile})
    return got.select("id", "kind", "parent_id", "file_path")


@query(f"""WITH x AS (SELECT 1), m AS (SELECT DISTINCT p_size AS k, 'bad/' || {_BRAND} || '_' || p_size || '.py' AS f FROM part)
SELECT 'python::file::' || f AS id, 'SyntaxError' AS error, NULL AS calls FROM m UNION ALL SELECT 'python::' || f || '::K' || k, NULL, NULL FROM m
UNION ALL SELECT 'python::' || f || '::K' || k || '::go', NULL, 'self.load_' || k || ',a.b,print' FROM m UNION ALL SELECT 'python::' || f || '::top', NULL, 'K' || k || ',fetch' FROM m""")
def fallback_calls(spark, d):
    """Files that don't parse, one per brand and size: their classes and functions, and the names called in them."""
    p = A.table(spark, d, "part").select(F.col("p_size").alias("k"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")).alias("b")).distinct()
    text = F.format_string('class K%1$d(Base):\n    """calls no(1)"""\n    def go(self, x=default(2)):\n        self.load_%1$d(a.b(x)) # not(3)\n        print("so(4)" "\n\ndef top(:\n    def inner(): pass\n    return K%1$d(fetch (1))\n', "k")
    files = p.select(F.concat(F.lit("bad/"), "b", F.lit("_"), "k", F.lit(".py")).alias("path"), text.alias("content"))
    return P.extract(files).select("id", F.split("error", ":")[0].alias("error"), F.when(F.size("calls") >= 0, F.array_join("calls", ",")).alias("calls"))


@query(f"""WITH x AS (SELECT 1), m AS (SELECT p_partkey AS k, {_BRAND} AS b, p_size AS s FROM part)
SELECT CASE WHEN s % 4 = 3 THEN 'BASE + ''/q''' ELSE '/' || b || '/' || k END AS route, CASE s % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'PUT,DELETE' WHEN 2 THEN 'WEBSOCKET' ELSE 'GET' END AS methods, CASE WHEN s % 2 = 0 THEN 'V.' ELSE '' END || 'f' || k AS label, 'api/' || b || '/' || k || '.py' AS file_path,
  CASE WHEN s % 3 = 0 THEN 'fastapi' WHEN s % 3 = 1 THEN 'flask' WHEN s % 4 IN (1, 3) THEN 'flask' ELSE 'fastapi' END AS framework, 'python::api/' || b || '/' || k || '.py::' || CASE WHEN s % 2 = 0 THEN 'V::' ELSE '' END || 'f' || k AS profile_id
FROM m ORDER BY route, file_path LIMIT 200""")
def list_entry_points(spark, d):
    """A file per part with one route, in a class or not, of four forms and with or without an import that tells the framework."""
    s, k = F.col("p_size"), F.col("p_partkey")
    b = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"))
    route = F.concat(F.lit("'/"), b, F.lit("/"), k, F.lit("'"))
    owner = F.when(s % 2 == 0, "router").otherwise("app")
    how = F.when(s % 4 == 0, F.concat(F.lit(".get("), route, F.lit(")"))).when(s % 4 == 1, F.concat(F.lit(".route("), route, F.lit(", methods=['put', 'delete'])"))).when(s % 4 == 2, F.concat(F.lit(".websocket(path="), route, F.lit(")"))).otherwise(".api_route(BASE + '/q')")
    pad = F.when(s % 2 == 0, "    ").otherwise("")
    text = F.concat(F.when(s % 3 == 0, "import fastapi\n").when(s % 3 == 1, "from flask import x\n").otherwise(""), F.when(s % 2 == 0, "class V:\n").otherwise(""), pad, F.lit("@"), owner, how, F.lit("\n"), pad, F.lit("def f"), k, F.lit("(x): pass\n"))
    part = A.spread(A.table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")
    files = part.select(F.concat(F.lit("api/"), b, F.lit("/"), k, F.lit(".py")).alias("path"), text.alias("content"))
    got = P.entry_points(files, storage.settle(P.extract(files)), limit=200)
    return got.select("route", F.array_join("http_methods", ",").alias("methods"), "label", "file_path", "framework", "profile_id")


@query("""WITH x AS (SELECT 1), m AS (SELECT DISTINCT p_size AS k FROM part)
SELECT 'python::db/m' || k || '.py::M' || k AS id, 'models.Model' AS bases, 'name:CharField:''n' || k || ''',max_length=' || k || ':2;more:TextField::4' AS fields, '''t' || k || '''' AS meta FROM m
UNION ALL SELECT 'python::db/m' || k || '.py::M' || k || '.Meta', '', '', NULL FROM m UNION ALL SELECT 'python::db/m' || k || '.py::Plain' || k, 'M' || k, '', NULL FROM m""")
def list_core_models(spark, d):
    """A file per part size with a model, its Meta and a class without fields, below a folder of models and below another."""
    sizes = A.table(spark, d, "part").select("p_size").distinct()
    text = F.format_string("class M%1$d(models.Model):\n    name = models.CharField('n%1$d', max_length=%1$d)\n    other = 3\n    more: str = fields.TextField()\n    class Meta:\n        table = 't%1$d'\nclass Plain%1$d(M%1$d):\n    x = list()\n", "p_size")
    files = sizes.select(F.concat(F.lit("db/m"), "p_size", F.lit(".py")).alias("path"), text.alias("content")).unionByName(sizes.select(F.concat(F.lit("web/m"), "p_size", F.lit(".py")).alias("path"), text.alias("content")))
    got = P.core_models(P.extract(files), limit=500)
    name = F.concat(F.substring_index("id", "::", 2), F.lit("::"), F.col("model_name"))
    fields = F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["field_type"], F.array_join(f["args"], ","), f["line"])), ";")
    return got.select(name.alias("id"), F.array_join("bases", ",").alias("bases"), fields.alias("fields"), F.try_element_at("meta", F.lit("table")).alias("meta"))


# ---------------------------------------------------------------- categories and noise

#: Folders and names that the queries give to parts by their keys, in turn; the words stand in the SQL too.
_FOLDERS = "src api services tests models utils lib/pipeline infra adapters sdk core/latest scripts web/views db config jobs/./etl integrations client domain tool-box sandbox workflows /opt agent src\\common auth retriever webhooks fixtures records".split()
_NAMES = "Order OrderService PartController PartModel HttpClient PartAdapter TestPart ConfigThing Provider PartUtils Big_Helper EntityView Hook Usecase Processor x_serializer Thing".split()
_VERBS = "go load_settings build_schema run_workflow make_client plain test_it get_view as-dto provider_of sdk_call mixin".split()


def _pick(words: list[str], key: str, step: int):
    return F.element_at(F.array(*[F.lit(w) for w in words]), ((F.col(key) / step).cast("long") % len(words) + 1).cast("int"))


def _picked_sql(words: list[str], step: int) -> str:
    return "[" + ", ".join("'" + w.replace("\\", "\\\\") + "'" for w in words).replace("\\\\", "\\") + f"][(p_partkey // {step}) % {len(words)} + 1]"


def _named(spark, d):
    p = A.spread(A.table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    path = F.concat(_pick(_FOLDERS, "p_partkey", 1), F.lit("/"), F.translate("p_name", " ", "_"), F.when(F.col("p_size") % 7 == 0, "_test").otherwise(""), F.lit(".py"))
    return p.select("p_partkey", F.when(F.col("p_size") != 1, path).alias("path"), F.when(F.col("p_size") % 5 != 0, _pick(_NAMES, "p_partkey", 7)).alias("class_name"), F.when(F.col("p_size") % 3 != 0, _pick(_VERBS, "p_partkey", 3)).alias("function_name"))


_NAMED = f"""SELECT p_partkey, CASE WHEN p_size <> 1 THEN {_picked_sql(_FOLDERS, 1)} || '/' || replace(p_name, ' ', '_') || CASE WHEN p_size % 7 = 0 THEN '_test' ELSE '' END || '.py' END AS path,
CASE WHEN p_size % 5 <> 0 THEN {_picked_sql(_NAMES, 7)} END AS class_name, CASE WHEN p_size % 3 <> 0 THEN {_picked_sql(_VERBS, 3)} END AS function_name FROM part"""

# ---- Fixed values of the categories, written for the SQL: keywords of paths and names, ends of names, root folders.
_CATEGORY = r"""SELECT p_partkey, CASE WHEN p IS NULL OR p = '' THEN 'implementation' ELSE list_max([
{'s': 1, 'p': 40, 'k': 'implementation'},
{'s': CASE WHEN contains(p, 'tests/') OR starts_with(p, 'tests') THEN 20 ELSE 0 END + CASE WHEN ends_with(p, 'test.py') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(p || ' ' || n, 'test|tests|testing|fixture|fixtures') THEN 15 ELSE 0 END + CASE WHEN r IN ('fixtures', 'tests', 'test') THEN 6 ELSE 0 END, 'p': 95, 'k': 'test'},
{'s': CASE WHEN r IN ('service', 'services', 'workflows', 'workflow') THEN 6 ELSE 0 END + CASE WHEN r IN ('agent', 'agentic_reasoning') THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(p, 'service|services|usecase|use_case|usecases|workflow|workflows|manager|managers|orchestrator|orchestrators|handler|handlers|processor|processors') OR regexp_matches(n, '(service|manager|workflow|handler|processor|orchestrator|usecase) ') THEN 10 ELSE 0 END + CASE WHEN contains(p, 'workflow') THEN 6 ELSE 0 END, 'p': 90, 'k': 'service'},
{'s': CASE WHEN r IN ('apis', 'api', 'apps', 'controller', 'controllers', 'routes', 'router', 'routers', 'views') THEN 6 ELSE 0 END + CASE WHEN r = 'api' THEN 12 ELSE 0 END
  + CASE WHEN regexp_matches(p, 'controller|controllers|router|routers|route|routes|view|views|endpoint|endpoints|api') OR regexp_matches(n, '(controller|router|endpoint|view) ') THEN 10 ELSE 0 END, 'p': 85, 'k': 'controller'},
{'s': CASE WHEN r IN ('pipeline', 'pipelines') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(p, 'pipeline|pipelines|ingest|ingestion|indexer|indexing|retriever|retrieval|etl|extract|loader|loaders|transform|transforms|batch|stream') THEN 6 ELSE 0 END, 'p': 80, 'k': 'data_pipeline'},
{'s': CASE WHEN r IN ('dto', 'entities', 'entity', 'model', 'models', 'schemas', 'schema') THEN 6 ELSE 0 END
  + CASE WHEN regexp_matches(p, 'model|models|entity|entities|schema|schemas|dto|document|documents|record|records|serializer|serializers') OR regexp_matches(n, '(model|entity|schema|record|document|dto) ') THEN 10 ELSE 0 END, 'p': 78, 'k': 'model'},
{'s': CASE WHEN r IN ('adapters', 'adapter', 'integration', 'integrations', 'plugin', 'plugins', 'providers', 'provider') THEN 6 ELSE 0 END
  + CASE WHEN regexp_matches(p, 'integration|intergration|connector|connectors|adapter|adapters|webhook|webhooks|plugin|plugins|thirdparty|third_party|provider|providers') OR regexp_matches(n, '(connector|adapter|integration|hook|provider) ') THEN 9 ELSE 0 END, 'p': 70, 'k': 'integration'},
{'s': CASE WHEN r IN ('clients', 'client', 'sdk') THEN 6 ELSE 0 END + CASE WHEN r = 'sdk' THEN 10 ELSE 0 END + CASE WHEN regexp_matches(p, 'sdk|client|clients|api_client') OR regexp_matches(n, '(client|sdk) ') THEN 8 ELSE 0 END, 'p': 65, 'k': 'sdk'},
{'s': CASE WHEN r IN ('configs', 'config', 'infra', 'infrastructure', 'jobs', 'ops', 'tasks') THEN 6 ELSE 0 END
  + CASE WHEN regexp_matches(p, 'config|configs|setting|settings|constant|constants|credential|credentials|secret|secrets|env|environment|logging|logger|metrics|monitor|monitoring|db|database|databases|migrations|registry|management|permission|permissions|auth|authentication|authorization|scheduler|schedulers|task|tasks|celery|cron|email|notification|notifications')
      OR regexp_matches(n, 'config|settings|provider') THEN 10 ELSE 0 END, 'p': 60, 'k': 'infrastructure'},
{'s': CASE WHEN r IN ('common', 'helpers', 'helper', 'lib', 'libs', 'shared', 'scripts', 'script', 'tooling', 'tools', 'utils', 'utility') THEN 6 ELSE 0 END + CASE WHEN r IN ('sandbox', 'scripts') THEN 6 ELSE 0 END
  + CASE WHEN regexp_matches(p || ' ' || n, 'util|utils|helper|helpers|common|shared|base|bases|mixins|constants|types|tool|toolbox') THEN 12 ELSE 0 END, 'p': 50, 'k': 'utility'}]).k END AS category
FROM (SELECT *, split_part(p, '/', 1) AS r0, CASE WHEN starts_with(p, '//') THEN '/' ELSE split_part(p, '/', 1) END AS r FROM (
  SELECT p_partkey, replace(replace(lower(replace(path, '\', '/')), '/./', '/'), '/opt/', '//opt/') AS p,
    coalesce(lower(class_name) || ' ' || replace(replace(lower(class_name), '-', ' '), '_', ' ') || ' ', '') || coalesce(lower(function_name) || ' ' || replace(replace(lower(function_name), '-', ' '), '_', ' ') || ' ', '') AS n FROM (NAMED)))"""


@query(_CATEGORY.replace("NAMED", _NAMED))
def node_category(spark, d):
    """The category of a profile for every part, by its path, class and function."""
    n = _named(spark, d)
    return n.select("p_partkey", link.category(F.col("path"), F.col("class_name"), F.col("function_name")).alias("category"))


_ROOTS = "json os re celery torch numpy service futile sklearn.linear Logger super() my_utils helperx self boto3 weaviate part tensorflowx asyncio __x__".split()
_TAILS = "run __init__ task path::join nn.Linear _x __a__".split()


@query(f"""SELECT p_partkey, noisy, noisy OR (starts_with(call, '__') AND ends_with(call, '__')) OR regexp_matches(call, '^(json|os|re|asyncio)(\\.|::|$)') AS noisy_outside FROM (SELECT p_partkey, call,
regexp_matches(call, '(^|[.:])__[^.:]*__$') OR starts_with(lower(call), 'super(') OR regexp_matches(lower(call), 'utils|helper|helpers') OR regexp_matches(lower(call), '^(aiohttp|anthropic|asyncio|azure|boto3|botocore|celery|chromadb|click|cv2|fastapi|google|httpx|jinja2|langchain|langgraph|milvus|numpy|openai|opensearch|pandas|pillow|pinecone|psycopg|pydantic|redis|requests|rich|scipy|sentry_sdk|sklearn|sqlalchemy|sqlmodel|supabase|tensorflow|torch|transformers|typer|uvicorn|weaviate)(\\.|::)') AS noisy
FROM (SELECT p_partkey, {_picked_sql(_ROOTS, 1)} || CASE WHEN p_size % 2 = 0 THEN '.' ELSE '::' END || {_picked_sql(_TAILS, 5)} AS call FROM part))""")
def noisy_calls(spark, d):
    """Whether a call is noise, in the graph and outside of it, for a call made of every part's key."""
    p = A.spread(A.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.concat(_pick(_ROOTS, "p_partkey", 1), F.when(F.col("p_size") % 2 == 0, ".").otherwise("::"), _pick(_TAILS, "p_partkey", 5)).alias("call"))
    return p.select("p_partkey", link.is_noisy_call(F.col("call")).alias("noisy"), link.is_noisy_external_call(F.col("call")).alias("noisy_outside"))


@query(f"""SELECT p_partkey FROM (SELECT n.*, ['file', 'class', 'function', 'method'][n.p_partkey % 4 + 1] AS kind FROM ({_NAMED}) n WHERE path IS NOT NULL) WHERE NOT (ends_with(path, '__init__.py') OR (kind <> 'file' AND (
regexp_matches(coalesce(function_name, ''), '^__.*__$') OR (kind IN ('function', 'method') AND regexp_matches(lower(path), 'utils|helper|helpers')) OR regexp_matches(lower(coalesce(function_name, '')), 'utils|helper|helpers') OR regexp_matches(lower(coalesce(class_name, '')), 'utils|helper|helpers'))))""")
def quiet_profiles(spark, d):
    """The parts whose profile is no noise."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("file", "class", "function", "method")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    n = _named(spark, d).filter("path is not null").withColumnRenamed("path", "file_path").withColumn("kind", kind)
    return n.filter(~link.is_noise(n)).select("p_partkey")


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'python::' || a || '/' || b || '.py::' || C WHEN 1 THEN 'python::' || a || '/' || C || '.py::Inner' WHEN 2 THEN 'python::' || a || '/' || b || '.py::' || C WHEN 3 THEN 'python::' || a || '/' || b || '.py::' || C WHEN 4 THEN a || '::' || b ELSE 'python::method::' || a || '.' || b END AS fixed
FROM (SELECT p_partkey, p_size, split_part(p_name, ' ', 1) AS a, lower(p_type) AS b, 'K' || p_size AS C FROM part)""")
def repaired_ids(spark, d):
    """Ids in the forms that models write them, for every part, mended."""
    a, b, c, k = F.split("p_name", " ")[0], F.lower("p_type"), F.concat(F.lit("K"), "p_size"), F.col("p_size") % 6
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    wrong = F.when(k == 0, text("python::class::", a, ".", b, ".", c)).when(k == 1, text("python::function::", a, ".", c, ".Inner")).when(k == 2, text("python::", a, ".", b, "::", c)).when(k == 3, text("python::", a, "/", b, ".py::", c)).when(k == 4, text(a, "::", b)).otherwise(text("python::method::", a, ".", b))
    return A.spread(A.table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey").select("p_partkey", S.repaired_id(wrong).alias("fixed"))


@query("""WITH c AS (SELECT target, count(*) AS n FROM edges WHERE type = 'INHERITS_FROM' GROUP BY target), top AS (SELECT id FROM (SELECT DISTINCT 'brand::' || p_brand AS id FROM part) LEFT JOIN c ON id = target ORDER BY coalesce(n, 0) DESC, id LIMIT 1)
SELECT 'dominant' AS role, id, id AS label FROM top UNION ALL SELECT DISTINCT 'child', source, (SELECT any_value(label) FROM nodes n WHERE n.id = source) FROM edges, top WHERE target = top.id AND type = 'INHERITS_FROM'""")
def inheritance_auto(spark, d):
    brands = A.table(spark, d, "part").select(F.concat(F.lit("brand::"), "p_brand").alias("id")).distinct().select("id", F.lit("class").alias("kind"), F.lit("").alias("category"), F.col("id").alias("label"), F.lit("parts").alias("file_path"))
    return lookup.inheritance(brands.unionByName(A.nodes(spark, d)), A.edges(spark, d), "parts")


@query("""WITH p AS (SELECT *, 'part::' || p_partkey AS me, coalesce(nullif(function_name, ''), nullif(class_name, ''), id) AS nm FROM (SELECT x.*, p_partkey, p_size FROM profiles x JOIN part ON id = 'part::' || p_partkey)),
s AS (SELECT e.me AS entry, o.p_partkey - e.p_partkey AS d, '--- Step ' || row_number() OVER (PARTITION BY e.me ORDER BY o.p_partkey) || ': ' || o.nm || ' ---' || chr(10) || '{' || chr(10) || '  "summary": ' || CASE o.p_size % 3 WHEN 0 THEN '"about ' || o.p_size || '"' WHEN 1 THEN '"deep"' ELSE 'null' END || ',' || chr(10) || '  "workflow_hints": ' || CASE WHEN o.p_size % 3 = 0 THEN '{' || chr(10) || '    "k": ' || o.p_size || chr(10) || '  }' ELSE 'null' END || chr(10) || '}' || chr(10) AS t
  FROM p e JOIN p o ON o.p_partkey > e.p_partkey AND o.p_partkey <= e.p_partkey + 2)
SELECT me AS entry, trim('### WORKFLOW ENTRY POINT: SOURCE CODE' || chr(10) || 'File: ' || file_path || chr(10) || 'Name: ' || nm || chr(10) || '```python' || chr(10) || source_code || chr(10) || '```' || chr(10) || chr(10) || '### KEY STEPS IN THE CALL CHAIN: SUMMARIES' || chr(10) || coalesce((SELECT string_agg(t, '' ORDER BY d) FROM s WHERE s.entry = me), ''), chr(10) || ' ') AS context FROM p""")
def workflow_contexts(spark, d):
    """For each part the context of a trace from it to the two parts after it."""
    k = F.col("p_size") % 3
    doc = F.when(k == 0, F.to_json(F.struct(F.concat(F.lit("about "), "p_size").alias("summary"), F.struct(F.col("p_size").alias("k")).alias("workflow_hints")))).when(k == 1, '{"summaries": {"level_1": {"text": "deep"}, "summary": "not this"}}')
    data = A.table(spark, d, "part").select(F.concat(F.lit("part::"), "p_partkey").alias("id"), doc.alias("data"))
    trace = A.table(spark, d, "part").select(F.concat(F.lit("part::"), "p_partkey").alias("entry"), "p_partkey", F.posexplode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("position", "more")).select("entry", F.col("position").cast("long").alias("position"), F.concat(F.lit("part::"), F.col("p_partkey") + F.col("more")).alias("id"))
    return workflows.llm_context(trace, A.profiles(spark, d).join(data, "id"))


@query("""WITH p AS (SELECT x.*, p_partkey, 'part::' || p_partkey AS me FROM profiles x JOIN part ON id = 'part::' || p_partkey)
SELECT me AS entry, coalesce(nullif(function_name, ''), nullif(class_name, ''), me) AS workflow_name, (SELECT greatest(1, count(*)) FROM part o WHERE o.p_partkey > p.p_partkey AND o.p_partkey <= p.p_partkey + 2)::BIGINT AS steps FROM p""")
def synthesized_workflow(spark, d):
    """The contexts of all parts, answered by a provider (here one without a model) and read as workflow documents."""
    got = workflows.synthesize(workflow_contexts(spark, d), workflows.stub_provider)
    return got.select("entry", F.col("document.workflow_name").alias("workflow_name"), F.size("document.steps").cast("long").alias("steps"))


@query("""WITH x AS (SELECT 1), d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN '{"a": "}{", "b": {"c": ' || doc_id || '}}' END AS found FROM d""")
def balanced_objects(spark, d):
    """The first object in a reply, for every document: among words, with braces in strings, twice, without an end."""
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    one = F.concat(F.lit('{"a": "}{", "b": {"c": '), i, F.lit("}}"))
    words = F.translate(F.substring(F.coalesce("text", F.lit("")), 1, 200), '{}"\\', "")
    reply = F.when(k == 0, F.concat(words, one, words)).when(k == 1, F.concat(one, F.lit(" and "), one)).when(k == 2, F.concat(words, F.lit('{"a": {'), words)).otherwise(F.concat(words, F.lit('{"a": "}'), words))
    return A.table(spark, d, "documents").select("doc_id", S.balanced_object(reply).alias("found"))


@query("""SELECT p_partkey, CASE WHEN k < 6 THEN b END AS owner, CASE WHEN k < 6 THEN 'r' || p_size END AS repo, CASE WHEN k = 2 THEN 'dev' END AS branch FROM (SELECT p_partkey, p_size, p_size % 8 AS k, lower(replace(p_brand, '#', '-')) AS b FROM part)""")
def repository_references(spark, d):
    k, b, r = F.col("p_size") % 8, F.lower(F.translate("p_brand", "#", "-")), F.concat(F.lit("r"), "p_size")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    page = text("https://github.com/", b, "/", r)
    url = F.when(k == 0, page).when(k == 1, text("  ", page, ".git/")).when(k == 2, text(page, "/tree/dev/x")).when(k == 3, text("git@github.com:", b, "/", r, ".git")).when(k == 4, text(b, "/", r)).when(k == 5, text("http://github.com/", b, "/", r, "/")).when(k == 6, text(page, "/issues")).otherwise(b)
    got = S.github_parts(url)
    return A.table(spark, d, "part").select("p_partkey", got["owner"].alias("owner"), got["repo"].alias("repo"), got["branch"].alias("branch"))
