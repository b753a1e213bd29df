"""Profiles to a typed graph: noise filters, aliases, resolution by one-to-many joins, edges, and node categories."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import compact, contains_any, ends_with_any, is_dunder, last_token, one_of, slashes

# ---- Fixed values: what a root folder says of a node's category.
ROOT_CATEGORY = {
    "adapters": "integration", "adapter": "integration", "apis": "controller", "api": "controller", "apps": "controller", "clients": "sdk", "client": "sdk",
    "common": "utility", "configs": "infrastructure", "config": "infrastructure", "controller": "controller", "controllers": "controller", "dto": "model",
    "entities": "model", "entity": "model", "fixtures": "test", "helpers": "utility", "helper": "utility", "infra": "infrastructure", "infrastructure": "infrastructure",
    "integration": "integration", "integrations": "integration", "jobs": "infrastructure", "lib": "utility", "libs": "utility", "model": "model", "models": "model",
    "ops": "infrastructure", "pipeline": "data_pipeline", "pipelines": "data_pipeline", "plugin": "integration", "plugins": "integration", "providers": "integration",
    "provider": "integration", "routes": "controller", "router": "controller", "routers": "controller", "schemas": "model", "schema": "model", "sdk": "sdk",
    "service": "service", "services": "service", "shared": "utility", "scripts": "utility", "script": "utility", "tasks": "infrastructure", "tests": "test", "test": "test",
    "tooling": "utility", "tools": "utility", "utils": "utility", "utility": "utility", "views": "controller", "workflows": "service", "workflow": "service",
}
# ---- Fixed values: priorities of categories when scores are equal.
PRIORITY = {"external": 100, "test": 95, "service": 90, "controller": 85, "data_pipeline": 80, "model": 78, "integration": 70, "sdk": 65, "infrastructure": 60, "utility": 50, "implementation": 40}
# ---- Fixed values: keywords, found anywhere in a path part or name token.
UTILITY = "util utils helper helpers common shared base bases mixins constants types tool toolbox".split()
INTEGRATION = "integration intergration connector connectors adapter adapters webhook webhooks plugin plugins thirdparty third_party provider providers".split()
SDK = "sdk client clients api_client".split()
SERVICE = "service services usecase use_case usecases workflow workflows manager managers orchestrator orchestrators handler handlers processor processors".split()
CONTROLLER = "controller controllers router routers route routes view views endpoint endpoints api".split()
MODEL = "model models entity entities schema schemas dto document documents record records serializer serializers".split()
PIPELINE = "pipeline pipelines ingest ingestion indexer indexing retriever retrieval etl extract loader loaders transform transforms batch stream".split()
INFRASTRUCTURE = (
    "config configs setting settings constant constants credential credentials secret secrets env environment logging logger metrics monitor monitoring db database databases "
    "migrations registry management permission permissions auth authentication authorization scheduler schedulers task tasks celery cron email notification notifications"
).split()
TEST = "test tests testing fixture fixtures".split()
# ---- Fixed values: ends of name tokens.
SERVICE_END = "service manager workflow handler processor orchestrator usecase".split()
CONTROLLER_END = "controller router endpoint view".split()
MODEL_END = "model entity schema record document dto".split()
INTEGRATION_END = "connector adapter integration hook provider".split()
SDK_END = "client sdk".split()
# ---- Fixed values: keywords of noise, and third-party roots whose calls are noise.
NOISE = "utils helper helpers".split()
THIRD_PARTY = (
    "aiohttp anthropic asyncio azure boto3 botocore celery chromadb click cv2 fastapi google httpx jinja2 langchain langgraph milvus numpy openai opensearch pandas pillow "
    "pinecone psycopg pydantic redis requests rich scipy sentry_sdk sklearn sqlalchemy sqlmodel supabase tensorflow torch transformers typer uvicorn weaviate"
).split()

#: Category, points, and the conditions of which one must hold. Conditions: (what, words); `path` looks for keywords in path parts, `name` in name tokens, `end` at the
#: ends of name tokens, `root` compares the first part, `joined` looks in the whole path, `starts` and `ends` at its ends.
RULES = [
    ("test", 20, [("joined", ["tests/"]), ("starts", ["tests"])]),
    ("test", 20, [("ends", ["test.py", "_test.py"])]),
    ("test", 15, [("path", TEST), ("name", TEST)]),
    *[(c, 6, [("root", [r for r, x in ROOT_CATEGORY.items() if x == c])]) for c in PRIORITY if c in ROOT_CATEGORY.values()],
    ("utility", 12, [("path", UTILITY), ("name", UTILITY)]),
    ("infrastructure", 10, [("path", INFRASTRUCTURE), ("name", ["config", "settings", "provider"])]),
    ("controller", 12, [("root", ["api"])]),
    ("controller", 10, [("path", CONTROLLER), ("end", CONTROLLER_END)]),
    ("service", 10, [("root", ["agent", "agentic_reasoning"])]),
    ("service", 10, [("path", SERVICE), ("end", SERVICE_END)]),
    ("service", 6, [("joined", ["workflow"])]),
    ("model", 10, [("path", MODEL), ("end", MODEL_END)]),
    ("data_pipeline", 6, [("path", PIPELINE)]),
    ("integration", 9, [("path", INTEGRATION), ("end", INTEGRATION_END)]),
    ("sdk", 10, [("root", ["sdk"])]),
    ("sdk", 8, [("path", SDK), ("end", SDK_END)]),
    ("utility", 6, [("root", ["sandbox", "scripts"])]),
]


def _any(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, xs)


def path_parts(path: Column) -> Column:
    """Lower-cased parts; an absolute path has the root as its first."""
    p = F.lower(slashes(F.coalesce(path, F.lit(""))))
    return F.concat(F.when(p.startswith("/"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>")), F.filter(F.split(p, "/"), lambda x: (x != "") & (x != ".")))


def name_tokens(class_name: Column, function_name: Column) -> Column:
    """Lower-cased names, whole and cut at underscores and hyphens."""
    one = lambda v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.array(F.lower(v)), F.filter(F.split(F.translate(F.lower(v), "-", "_"), "_"), lambda x: x != ""))).otherwise(F.array().cast("array<string>"))
    return F.concat(one(class_name), one(function_name))


def category(path: Column, class_name: Column, function_name: Column) -> Column:
    """Additive scores by RULES; the best (score, priority) wins. Keywords are substrings, so `latest` counts as test."""
    parts, tokens = path_parts(path), name_tokens(class_name, function_name)
    root, joined = F.get(parts, F.lit(0)), F.array_join(parts, "/")
    holds = {
        "path": lambda w: contains_any(parts, w), "name": lambda w: contains_any(tokens, w), "end": lambda w: ends_with_any(tokens, w), "root": lambda w: F.coalesce(root.rlike(f"^{one_of(w)}$"), F.lit(False)),
        "joined": lambda w: joined.rlike(one_of(w)), "starts": lambda w: joined.rlike("^" + one_of(w)), "ends": lambda w: joined.rlike(one_of(w) + "$"),
    }
    scores = {"implementation": F.lit(1)}
    for kind, points, conditions in RULES:
        scores[kind] = scores.get(kind, F.lit(0)) + F.when(_any([holds[what](words) for what, words in conditions]), points).otherwise(0)
    best = F.array_max(F.array(*[F.struct(s.cast("int").alias("s"), F.lit(PRIORITY[k]).alias("p"), F.lit(k).alias("k")) for k, s in scores.items()]))["k"]
    return F.when(F.size(parts) == 0, "implementation").otherwise(best)


def is_noise(p: DataFrame) -> Column:
    """Everything in package markers, dunders, functions that live under or are named after helpers, and classes so named; other files stay."""
    f, c = F.coalesce("function_name", F.lit("")), F.coalesce("class_name", F.lit(""))
    some = lambda x: F.lower(x).rlike(one_of(NOISE))
    routine = F.col("kind").isin("function", "method")
    other = is_dunder(f) | (routine & some(F.col("file_path"))) | some(f) | some(c)
    return F.col("file_path").endswith("__init__.py") | ((F.col("kind") != "file") & other)


def is_noisy_call(call: Column) -> Column:
    low = F.lower(call)
    third = low.rlike(rf"^{one_of(THIRD_PARTY)}(\.|::)")
    return is_dunder(last_token(call)) | low.startswith("super(") | low.startswith("super::") | low.rlike(one_of(NOISE)) | third


def is_stdlib_call(call: Column) -> Column:
    return F.split(F.split(call, r"\.")[0], "::")[0].rlike(f"^{one_of(sorted(sys.stdlib_module_names))}$")


def is_noisy_external_call(call: Column) -> Column:
    """Of calls that no alias resolves."""
    return is_noisy_call(call) | is_dunder(call) | is_stdlib_call(call)


def label(p: DataFrame) -> Column:
    return F.coalesce(F.when(F.col("class_name").isNotNull() & F.col("function_name").isNotNull(), F.concat_ws(".", "class_name", "function_name")), "function_name", "class_name", "file_path")


def module_of(path: Column) -> Column:
    return F.translate(F.regexp_replace(slashes(path), r"([^/])\.[^./]+$", "$1"), "/", ".")


def aliases() -> Column:
    """All names by which a profile may be called. Of a nested class, the module goes with its last name alone."""
    m, c, f = module_of(F.col("file_path")), F.col("class_name"), F.col("function_name")
    simple = F.element_at(F.split(c, r"\."), -1)
    both = lambda *x: [F.when(F.concat(*x).isNotNull(), F.concat_ws(s, *x)) for s in (".", "::")]
    every = [F.col("id"), F.col("file_path"), m, F.regexp_replace(m, r"\.", "::"), slashes(F.col("file_path")), f, c, *both(m, simple), *both(c, f), *both(m, simple, f), *both(m, f)]
    return F.array_distinct(F.filter(F.transform(F.array(*every), compact), lambda x: x.isNotNull() & (x != "")))


def import_aliases(i: str) -> Column:
    mod, name = F.col(f"{i}.module"), F.col(f"{i}.name")
    full = F.when(mod.isNotNull() & name.isNotNull(), F.concat(mod, F.lit("."), name)).otherwise(F.coalesce(mod, name))
    as_path = F.when(mod.endswith(".py"), mod).otherwise(F.concat(F.translate(mod, ".", "/"), F.lit(".py")))
    every = [full, F.regexp_replace(full, r"\.", "::"), mod, F.regexp_replace(mod, r"\.", "::"), as_path, name, F.concat(mod, F.lit("::"), name), F.concat(as_path, F.lit("::"), name)]
    return F.array_distinct(F.filter(F.transform(F.array(*every), compact), lambda x: x.isNotNull() & (x != "")))


def first_seen(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """keys and the list of their different values, each where it is first seen. Null and empty values are left out; a group without any has an empty list. Repeats are dropped before the groups are gathered."""
    once = rows.groupBy(*keys, value).agg(F.min(position).alias(position))
    there = F.when(F.coalesce(F.col(value), F.lit("")) != "", F.struct(position, value))
    return once.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(there)), lambda x: x[value]).alias(value))


def build(profiles: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes and edges(source, target, type, resolved, payload). strict: only classes are inherited from, only functions called by name. Edges are unique by (source, target, type); a payload counts once, where it is first seen: in the order
    of its source's uses, then calls."""
    p = profiles.filter(~is_noise(profiles))
    nodes = p.select("id", "kind", category(F.col("file_path"), F.col("class_name"), F.col("function_name")).alias("category"), label(p).alias("label"), "file_path", "function_name", "class_name")
    index = p.select(F.explode(aliases()).alias("alias"), F.col("id").alias("target"), F.col("kind").alias("target_kind")).distinct()
    site = lambda df, kind: df.select(F.col("id").alias("source"), "at", "alias", F.lit(kind).alias("want"), "payload", F.col("made") if "made" in df.columns else F.lit(None).cast("string").alias("made"))
    tell = lambda *c: F.to_json(F.struct(*c))
    imports = p.filter("kind = 'file'").select("id", F.posexplode("import_sites").alias("at", "i")).select("id", "at", F.explode(import_aliases("i")).alias("alias"), tell(F.col("i.line"), F.nullif(F.col("i.module"), F.lit("")).alias("module"), F.nullif(F.col("i.name"), F.lit("")).alias("symbol"), compact(F.concat_ws(".", F.nullif(F.col("i.module"), F.lit("")), F.nullif(F.col("i.name"), F.lit("")))).alias("qualified"), F.nullif(F.col("i.alias"), F.lit("")).alias("alias")).alias("payload"))
    parents = p.filter("kind = 'class'").select("id", F.posexplode("inheritance").alias("at", "i")).select("id", "at", compact(F.col("i.symbol")).alias("alias"), tell("i.symbol", "i.line").alias("payload"))
    uses = p.select("id", F.posexplode("uses").alias("at", "i")).select("id", "at", compact(F.col("i.symbol")).alias("alias"), tell("i.symbol", "i.use_kind", "i.line", "i.detail").alias("payload"))
    flat = F.when(F.size("call_sites") > 0, F.col("call_sites")).otherwise(F.transform("calls", lambda c: F.struct(c.alias("expression"), F.lit(0).alias("line"))))
    calls = p.filter(F.col("kind").isin("function", "method")).select("id", F.posexplode(flat).alias("at", "i")).select("id", "at", compact(F.col("i.expression")).alias("alias"), tell("i.expression", F.nullif(F.col("i.line"), F.lit(0)).alias("line")).alias("payload"), tell(F.col("i.expression").alias("symbol"), F.lit("INSTANTIATION").alias("use_kind"), F.col("i.line")).alias("made"))
    sites = site(imports, "IMPORTS").unionByName(site(parents, "INHERITS_FROM")).unionByName(site(uses, "USES")).unionByName(site(calls, "CALLS"))
    hit = sites.join(index, "alias")
    if strict:
        hit = hit.filter((F.col("want") != "INHERITS_FROM") | (F.col("target_kind") == "class"))
    kind = F.when((F.col("want") == "CALLS") & (F.col("target_kind") == "class"), "USES").otherwise(F.col("want"))
    seen_at = F.struct((F.col("want") == "CALLS").alias("call"), "at").alias("at")
    resolved = hit.filter((F.col("source") != F.col("target")) | (F.col("want") == "CALLS")).select("source", "target", kind.alias("type"), F.lit(True).alias("resolved"), F.when((F.col("want") == "CALLS") & (F.col("target_kind") == "class"), F.col("made")).otherwise(F.col("payload")).alias("payload"), seen_at)
    lost = site(calls, "CALLS").join(index.select("alias").distinct(), "alias", "left_anti").filter(~is_noisy_external_call(F.col("alias")))
    outside = lost.select("source", F.concat(F.lit("external::"), "alias").alias("target"), F.lit("CALLS").alias("type"), F.lit(False).alias("resolved"), "payload", seen_at)
    inner = p.select(F.col("id").alias("source"), F.posexplode("children").alias("at", "target")).join(p.select(F.col("id").alias("target"), F.struct(F.col("kind").alias("child_kind"), F.col("start_line").alias("line")).alias("x")), "target")
    contains = inner.select("source", "target", F.lit("CONTAINS").alias("type"), F.lit(True).alias("resolved"), F.to_json("x").alias("payload"), F.struct(F.lit(False).alias("call"), "at").alias("at"))
    edges = first_seen(contains.unionByName(resolved).unionByName(outside), ["source", "target", "type", "resolved"], "payload", "at")
    external = outside.select("target").distinct().select(F.col("target").alias("id"), F.lit("external_call").alias("kind"), F.lit("external").alias("category"), F.substring("target", 11, 1 << 20).alias("label"), *(F.lit(None).cast("string").alias(c) for c in ("file_path", "function_name", "class_name")))
    return nodes.unionByName(external), edges
