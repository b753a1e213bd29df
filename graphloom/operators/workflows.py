"""Workflow documents and drilldown responses: normalising, validating, joining targets, defaults."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S

STEP = "array<struct<step_number:int,action:string,component:string,details:string>>"
#: Bytes of source texts that a task of contexts takes, about.
TASK_BYTES = 32 << 20
# ---- Fixed values: what semantic fields may hold.
ROLES = "gateway processor sink orchestrator validator transformer aggregator dispatcher adapter mediator repository factory strategy".split()
POSITIONS = "entry_point validation processing transformation aggregation storage output error_handling".split()
RISKS = "critical high medium low".split()


def workflow(doc: Column) -> Column:
    """A workflow document (text) as name and steps: as it is if valid, else from key_steps with defaults; null if neither."""
    at = lambda path: F.get_json_object(doc, path)
    entry = lambda k: F.nullif(at(f"$.workflow_entry_point.{k}"), F.lit(""))
    named = F.nullif(F.trim(at("$.workflow_name")), F.lit(""))
    whole = F.from_json(at("$.steps"), "array<map<string,string>>")
    needed = ("step_number", "action", "component", "details")
    valid = named.isNotNull() & (F.size(whole) > 0) & F.forall(whole, lambda m: F.size(F.array_except(F.array(*[F.lit(x) for x in needed]), F.map_keys(m))) == 0)
    direct = F.transform(whole, lambda m: F.struct(F.try_element_at(m, F.lit("step_number")).cast("int").alias("step_number"), *(F.try_element_at(m, F.lit(x)).alias(x) for x in needed[1:])))
    keyed = F.from_json(at("$.key_steps"), "array<string>")
    home = F.coalesce(entry("class"), entry("file"), F.lit("unknown_component"))

    def step(s: Column, i: Column) -> Column:
        of = lambda k: F.nullif(F.get_json_object(s, f"$.{k}"), F.lit(""))
        is_map, nth = F.trim(s).startswith("{"), F.concat(F.lit("Step "), i + 1)
        action = F.when(is_map, F.coalesce(of("action"), of("step"), nth)).otherwise(s)
        return F.struct(
            (i + 1).cast("int").alias("step_number"), F.coalesce(F.nullif(F.trim(action), F.lit("")), nth).alias("action"),
            F.coalesce(F.nullif(F.trim(F.when(is_map, F.coalesce(of("component"), home)).otherwise(home)), F.lit("")), F.lit("unknown_component")).alias("component"),
            F.coalesce(F.nullif(F.trim(F.when(is_map, F.coalesce(of("details"), of("description")))), F.lit("")), F.lit("Details not provided.")).alias("details"),
        )

    name = F.coalesce(named, entry("name"), entry("class"), entry("file"), F.lit("Workflow"))
    return F.when(valid, F.struct(named.alias("workflow_name"), direct.cast(STEP).alias("steps"))).when(F.size(keyed) > 0, F.struct(F.trim(name).alias("workflow_name"), F.transform(keyed, step).cast(STEP).alias("steps")))


def hints(data: Column) -> Column:
    """Workflow hints of a profile's document: its own, those of its summaries, or of the first level."""
    one = lambda path: F.when(F.get_json_object(data, path).startswith("{"), F.get_json_object(data, path))
    return F.coalesce(one("$.workflow_hints"), one("$.summaries.workflow_hints"), one("$.summaries.level_1.workflow_hints"))


def summary(doc: Column) -> Column:
    """The narrative of a summary document: level 1, else its own, else the whole."""
    of = lambda path: F.nullif(F.get_json_object(doc, path), F.lit(""))
    return F.coalesce(of("$.level_1.summary"), of("$.level_1.text"), F.get_json_object(doc, "$.summary"), doc)


def pattern(reply: Column) -> Column:
    """The pattern that a reply names: type A, B or C, confidence 0 to 1, reasoning, and at least one tool; null if any is missing. The JSON starts at the first brace."""
    text = F.when(F.length(reply) >= 50, F.coalesce(S.json_in_text(reply), S.balanced_object(reply)))
    whole = F.coalesce(F.get_json_object(text, "$.scout_pattern_identification"), F.when(F.get_json_object(text, "$.pattern_type").isNotNull(), text))
    kind, sure = F.get_json_object(whole, "$.pattern_type"), F.get_json_object(whole, "$.confidence").try_cast("double")
    tools = F.from_json(F.get_json_object(whole, "$.tools_called"), "array<string>")
    good = kind.isin("A", "B", "C") & sure.between(0, 1) & (F.trim(F.get_json_object(whole, "$.reasoning")) != "") & (F.size(tools) > 0)
    return F.when(good, F.struct(kind.alias("pattern_type"), sure.alias("confidence"), F.get_json_object(whole, "$.reasoning").alias("reasoning"), tools.alias("tools_called")))


def tool_summary(messages: DataFrame, key: str, order: str, found: Column | None = None) -> DataFrame:
    """key, pattern, results: the tool messages (type, name, content) of each conversation in order, without the talk between them."""
    rows = messages.filter(F.col("type") == "tool").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("name", F.lit("unknown_tool")).alias("tool"), F.col("content").alias("result")))), lambda x: F.struct(x["tool"].alias("tool"), x["result"].alias("result"))).alias("results"))
    every = messages.select(key).distinct().join(rows, key, "left")
    return every.select(key, F.coalesce(found if found is not None else F.lit(None).cast("string"), F.lit("pending_analysis")).alias("pattern"), F.to_json(F.coalesce("results", F.array().cast("array<struct<tool:string,result:string>>"))).alias("results"))


#: What a message is called in a log, by its type.
MESSAGES = {"system": "SystemMessage", "human": "HumanMessage", "ai": "AIMessage", "tool": "ToolMessage"}


def coerced_text(content: Column) -> Column:
    """Text as it is; of a JSON list its texts and the `text` of its objects, on lines of their own; what holds neither is left out."""
    parts = F.transform(F.from_json(content, "array<string>"), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x))
    return F.when(content.startswith("["), F.coalesce(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n"), content)).otherwise(content)


def message_rows(messages: DataFrame, key: str, order: str) -> DataFrame:
    """key, index (from 1), type, content, tool_calls, tool_call_id of messages (type, content, tool_calls, tool_call_id): calls only of the model's messages, ids only of a tool's."""
    kinds = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")
    only = lambda kind, c: F.when((F.col("type") == kind) & (F.coalesce(F.col(c), F.lit("")) != ""), F.col(c)).alias(c)
    return messages.select(key, place.alias("index"), F.try_element_at(kinds, F.col("type")).alias("type"), coerced_text(F.coalesce("content", F.lit(""))).alias("content"), only("ai", "tool_calls"), only("tool", "tool_call_id"))


def reduced_messages(messages: DataFrame, key: str, order: str, prompt: Column, found: Column | None = None) -> DataFrame:
    """key, place, type, content: three messages instead of a conversation's whole stack: the prompt, the first human message if there is one, and the findings of its tools."""
    first = messages.groupBy(key).agg(F.min_by("content", F.when(F.col("type") == "human", F.col(order))).alias("request"), F.count_if(F.col("type") == "human").alias("_n"))
    told = tool_summary(messages, key, order, found)
    say = lambda place, kind, text: F.struct(F.lit(place).alias("place"), F.lit(kind).alias("type"), text.alias("content"))
    findings = F.concat(F.lit("Pattern: "), F.col("pattern"), F.lit("\nFindings of the tools:\n"), F.col("results"))
    rows = first.join(told, key).select(key, F.explode(F.array(say(1, "system", prompt), F.when(F.col("_n") > 0, say(2, "human", F.col("request"))), say(3, "human", findings))).alias("m"))
    return rows.filter("m is not null").select(key, "m.place", "m.type", "m.content")


def _narrative(payload):
    """What tells of a step: the first level's summary or text, else the document's own summary, else all of it."""
    if isinstance(payload, dict):
        first = payload.get("level_1")
        told = (first.get("summary") or first.get("text")) if isinstance(first, dict) else None
        return told or payload.get("summary", payload)
    return payload


def step_document(data: Column) -> Column:
    """The narrative and the hints of a step as a JSON document with indentation; data is a profile's document as JSON text, or null."""

    @F.pandas_udf("string")
    def run(documents: pd.Series, hinted: pd.Series) -> pd.Series:
        out = []
        for text, hint in zip(documents, hinted, strict=True):
            doc = json.loads(text) if text else {}
            told = doc.get("summary") if doc.get("summary") is not None else doc.get("summaries")
            out.append(json.dumps({"summary": _narrative(told), "workflow_hints": json.loads(hint) if hint else None}, indent=2))
        return pd.Series(out, dtype=object)

    return run(data, hints(data))


def llm_context(trace: DataFrame, profiles: DataFrame) -> DataFrame:
    """entry, context: for each trace (entry, position, id; or one trace without the column entry) the entry's source and the numbered steps, each with its summary and hints as JSON. Profiles may have a column `data`, a document
    with summaries and hints; where it has none, both are null. Ids without a profile and repeats of the entry are left out, steps are numbered without gaps."""
    trace = trace if "entry" in trace.columns else trace.crossJoin(F.broadcast(trace.filter("position = 0").select(F.col("id").alias("entry")).limit(1)))  # one row
    data = F.col("data") if "data" in profiles.columns else F.lit(None).cast("string")
    name = S.first_given(F.col("function_name"), F.col("class_name"), F.get_json_object(data, "$.name"), F.col("id"))
    known = profiles.select("id", "file_path", name.alias("name"), "source_code", data.alias("data"))
    # tasks by the bytes of the texts: these compress so well that the shuffled bytes say nothing of the memory that a task needs
    size = known.agg(F.sum(F.coalesce(F.octet_length("source_code"), F.lit(0)).cast("long") + F.coalesce(F.octet_length("data"), F.lit(0)))).first()[0] or 0
    tasks = max(trace.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    got = trace.repartition(tasks, "id").join(known.repartition(tasks, "id").hint("merge"), "id").filter((F.col("position") == 0) | (F.col("id") != F.col("entry")))
    # only the entry's own source is shown
    got = got.withColumn("source_code", F.when(F.col("position") == 0, F.col("source_code"))).withColumn("about", step_document(F.col("data"))).drop("data")
    numbered = got.repartition(tasks, "entry").withColumn("n", F.sum(F.when(F.col("position") > 0, 1).otherwise(0)).over(Window.partitionBy("entry").orderBy("position")))
    head = F.concat(F.lit("### WORKFLOW ENTRY POINT: SOURCE CODE\nFile: "), F.coalesce("file_path", F.lit("")), F.lit("\nName: "), F.col("name"), F.lit("\n```python\n"), F.coalesce("source_code", F.lit("")), F.lit("\n```\n"))
    step = F.concat(F.lit("--- Step "), F.col("n"), F.lit(": "), F.col("name"), F.lit(" ---\n"), F.col("about"), F.lit("\n"))
    lines = numbered.select("entry", "position", F.when(F.col("position") == 0, head).alias("head"), F.when(F.col("position") > 0, step).alias("step"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("position", "step")))), lambda x: x["step"]), "")
    whole = F.concat(F.coalesce(F.max("head"), F.lit("")), F.lit("\n### KEY STEPS IN THE CALL CHAIN: SUMMARIES\n"), joined)
    return lines.groupBy("entry").agg(F.regexp_replace(whole, r"^\s+|\s+$", "").alias("context"))


def synthesize(contexts: DataFrame, provider, key: str = "entry") -> DataFrame:
    """key, raw, document, error: contexts (key, context) answered by a provider (text to text, or a raised error). Errors named Retryable are raised, so that the task runs again."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for k, c in zip(f[key], f["context"], strict=True):
                try:
                    rows.append((k, provider(c), None))
                except Exception as e:
                    if type(e).__name__.startswith("Retryable"):
                        raise
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "raw", "error"])

    got = contexts.select(key, "context").mapInPandas(run, f"{contexts.select(key).schema.simpleString()[7:-1].replace(':', ' ')}, raw string, error string")
    return got.select(key, "raw", workflow(S.json_in_text(F.col("raw"))).alias("document"), "error")


def stub_provider(context: str) -> str:
    """An answer without a model: the steps that the context names."""
    import re

    steps = re.findall(r"^--- Step \d+: (.*) ---$", context, re.M)
    return json.dumps({"workflow_name": (re.findall(r"^Name: (.*)$", context, re.M) or ["Workflow"])[0], "key_steps": steps or ["start"]})


# ---------------------------------------------------------------- drilldown responses


def semantic(doc: Column) -> Column:
    """Semantic fields of a reply: enums in any case, unknown ones null; workflows as a list or as text with commas."""
    at = lambda k: F.get_json_object(doc, f"$.{k}")
    flows = F.coalesce(F.from_json(at("impacted_workflows"), "array<string>"), S.comma_list(at("impacted_workflows")), F.array().cast("array<string>"))
    return F.when(doc.isNotNull(), F.struct(
        S.enum_or_null(at("semantic_role"), ROLES).alias("semantic_role"), at("business_context").alias("business_context"), at("business_significance").alias("business_significance"),
        S.enum_or_null(at("flow_position"), POSITIONS).alias("flow_position"), S.enum_or_null(at("risk_level"), RISKS).alias("risk_level"), at("dependencies_description").alias("dependencies_description"), flows.alias("impacted_workflows"),
    ))


def drilldown(nodes: DataFrame, profiles: DataFrame) -> DataFrame:
    """nodes (node_key, title, node_type, description, kind, target_id, sequence_order) with mended targets, null where no profile has them, and problems of their actions."""
    fixed = nodes.withColumn("wanted", S.repaired_id(F.col("target_id")))
    known = profiles.select(F.col("id").alias("wanted"), F.lit(True).alias("known")).distinct()
    got = fixed.join(known, "wanted", "left")
    return got.select("node_key", "title", "node_type", "description", F.col("kind").alias("action_kind"), F.when(F.col("known"), F.col("wanted")).alias("target_id"), "sequence_order", F.when(~F.coalesce(S.action_valid(F.col("node_type"), F.col("kind")), F.lit(False)), "action does not fit the node's type").alias("problem"))


def overview(plan: Column) -> Column:
    """component cards of a plan document, with defaults."""
    card = "array<struct<component_id:string,module_name:string,business_signal:string,confidence:string,objective:array<string>,architecture_layer:string,rank:int,directory:string>>"
    return F.transform(F.from_json(F.get_json_object(plan, "$.component_cards"), card), lambda c: F.struct(
        *(F.coalesce(c[k], F.lit("")).alias(k) for k in ("component_id", "module_name", "business_signal")), F.coalesce(c["confidence"], F.lit("medium")).alias("confidence"),
        F.coalesce(c["objective"], F.array().cast("array<string>")).alias("objective"), c["architecture_layer"].alias("architecture_layer"), c["rank"].alias("rank"), c["directory"].alias("directory"),
    ))


CRUMB = "struct<node_key:string,title:string,node_type:string,target_id:string,metadata:string>"


def breadcrumbs(rows: Column, clicked: Column | None = None) -> Column:
    """Breadcrumb documents (array of text) as structs, the title falling back to the label; the clicked node last, with metadata only where it has parameters."""
    of = lambda x, k: F.coalesce(F.get_json_object(x, f"$.{k}"), F.lit(""))
    crumb = lambda x, meta: F.struct(of(x, "node_key").alias("node_key"), F.coalesce(F.get_json_object(x, "$.title"), F.get_json_object(x, "$.label"), F.lit("")).alias("title"), of(x, "node_type").alias("node_type"), F.get_json_object(x, "$.target_id").alias("target_id"), meta.alias("metadata")).cast(CRUMB)
    out = F.transform(rows, lambda x: crumb(x, F.coalesce(F.get_json_object(x, "$.metadata"), F.lit("{}"))))
    if clicked is None:
        return out
    params = F.get_json_object(clicked, "$.action_parameters")
    meta = F.when(params.isNotNull() & ~params.isin("{}", "null", ""), F.concat(F.lit('{"action_parameters":'), params, F.lit("}"))).otherwise("{}")
    return F.when(clicked.isNull(), out).otherwise(F.concat(out, F.array(crumb(clicked, meta))))


def focus(crumbs: Column) -> Column:
    return F.try_element_at(crumbs, F.lit(-1))


def subagent_payload(payload: Column, objective: Column) -> Column:
    """payload (a map) with the trimmed objectives that are not blank, unless it has its own; null if there is nothing."""
    clean = F.filter(F.transform(objective, lambda x: F.trim(x)), lambda x: x != "")
    own = F.coalesce(payload, F.create_map().cast("map<string,string>"))
    more = F.when(~F.map_contains_key(own, "objective") & (F.size(clean) > 0), F.map_concat(own, F.create_map(F.lit("objective"), F.to_json(clean)))).otherwise(own)
    return F.when(F.size(more) > 0, more)
