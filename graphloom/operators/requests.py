"""Texts and documents of requests: cards with breadcrumbs and a focus, prompts by pattern, a catalogue of operators, dumps of graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: roles and positions that a component of each pattern may have, and its risks.
ROLES = {"A": "REPOSITORY FACTORY GATEWAY MEDIATOR ORCHESTRATOR", "B": "ORCHESTRATOR PROCESSOR DISPATCHER VALIDATOR TRANSFORMER", "C": "GATEWAY ADAPTER MEDIATOR PROCESSOR SINK"}
POSITIONS = {"A": "ENTRY_POINT PROCESSING AGGREGATION STORAGE", "B": "ENTRY_POINT VALIDATION PROCESSING TRANSFORMATION OUTPUT", "C": "ENTRY_POINT PROCESSING OUTPUT ERROR_HANDLING"}
RISKS = "CRITICAL HIGH MEDIUM LOW"
#: What a component of each pattern is called in its prompt.
KINDS = {"A": "registry or factory", "B": "workflow or orchestrator", "C": "service interface"}
#: Types of nodes whose inside is code.
CODE = ("class", "function", "method", "module")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def semantic_prompt(pattern: Column, component: Column, findings: Column, class_name: Column, context: Column) -> Column:
    """The request for the seven semantic fields of a component, with the roles and positions that its pattern (A, B or C, in any case) allows. Any other pattern fails the query."""
    about = F.coalesce(context, F.lit(""))
    told = F.when(F.coalesce(class_name, F.lit("")) != "", F.regexp_replace(_text("Focusing on class: ", class_name, "\n", about), r"^\s+|\s+$", "")).otherwise(about)
    p, out = F.upper(F.coalesce(pattern, F.lit(""))), F.raise_error(_text("Unknown pattern: ", F.upper(F.coalesce(pattern, F.lit(""))), ". Expected 'A', 'B', or 'C'")).cast("string")
    for k in ROLES:
        fields = [
            f"semantic_role: one of {', '.join(ROLES[k].split())}", "business_context: what it does for the business, in a sentence or two", "business_significance: why that matters",
            f"flow_position: one of {', '.join(POSITIONS[k].split())}", f"risk_level: how bad a failure would be, one of {', '.join(RISKS.split())}", "dependencies_description: what it depends on or serves", "impacted_workflows: a list of workflows",
        ]
        asked = "\n".join(f"{i}. {x}" for i, x in enumerate(fields, 1))
        text = _text(f"Describe what this {KINDS[k]} means for the business.\n\nComponent: ", component, "\n\nFindings:\n", findings, F.when(told != "", _text("\n\nContext: ", told)).otherwise(""), f"\n\nAnswer with one JSON object of these fields only:\n{asked}")
        out = F.when(p == k, text).otherwise(out)
    return out


def compact_card(card: Column) -> Column:
    """The fields of a card (JSON) that a request carries; entry points only if there are some."""
    of = lambda k, empty: F.coalesce(F.get_json_object(card, f"$.{k}"), F.lit(empty))
    quoted = lambda k: F.coalesce(F.substring(F.to_json(F.array(F.get_json_object(card, f"$.{k}"))), F.lit(2), F.length(F.to_json(F.array(F.get_json_object(card, f"$.{k}")))) - 2), F.lit("null"))
    texts = [_text(f'"{k}":', F.when(F.get_json_object(card, f"$.{k}").isNull(), "null").otherwise(quoted(k))) for k in ("component_id", "module_name", "directory", "business_signal")]
    lists = [_text(f'"{k}":', of(k, "[]")) for k in ("leading_landmarks", "core_models")]
    entry = F.when(~of("primary_entry_points", "[]").isin("[]", "null", ""), _text('"primary_entry_points":', of("primary_entry_points", "[]")))
    return _text("{", F.concat_ws(",", *texts, *lists, entry), "}")


def focus_paths(crumbs: Column) -> Column:
    """Files that the last breadcrumb stands for, if it is a group of files."""
    return F.from_json(F.get_json_object(F.try_element_at(crumbs, F.lit(-1))["metadata"], "$.action_parameters.paths"), "array<string>")


def focus_section(crumbs: Column, component: Column) -> Column:
    """What to look at, by the last of the breadcrumbs (structs with title, node_type, target_id, metadata): a group of files by its list, code by its subgraph, else any target, else by type; empty without breadcrumbs."""
    last, paths = F.try_element_at(crumbs, F.lit(-1)), focus_paths(crumbs)
    target = F.nullif(last["target_id"], F.lit(""))
    anchor = F.coalesce(target, last["title"])
    how = (
        F.when(F.size(paths) > 0, _text("Group of files: scan these only.\n", F.array_join(F.transform(paths, lambda p: F.concat(F.lit("  - "), p)), "\n")))
        .when(last["node_type"].isin(*CODE), _text("Inside of a ", last["node_type"], ': extract_subgraph(anchor_node_id="', anchor, '", max_depth=1).'))
        .when(target.isNotNull(), _text('Node of the graph: extract_subgraph(anchor_node_id="', target, '", max_depth=1).'))
        .otherwise("No target: choose the tool by the node's type.")
    )
    path = F.array_join(F.concat(F.array(F.coalesce(component, F.lit(""))), F.transform(crumbs, lambda c: c["title"])), " > ")
    return F.when(F.size(crumbs) > 0, _text("# CURRENT FOCUS (Drilldown Depth: ", F.size(crumbs).cast("string"), ")\nPath: ", path, "\nNode: ", last["title"], " (type: ", last["node_type"], ")\n", how)).otherwise("")


def component_request(card: Column, crumbs: Column, objectives: Column) -> Column:
    """The user's part of a request: the compact card, breadcrumbs and objectives as one JSON object, then the focus. Empty targets and metadata of breadcrumbs are left out."""
    crumb = F.transform(crumbs, lambda c: F.struct(c["node_key"].alias("node_key"), c["title"].alias("title"), c["node_type"].alias("node_type"), F.nullif(c["target_id"], F.lit("")).alias("target_id"), F.when(~F.coalesce(c["metadata"], F.lit("{}")).isin("{}", ""), F.parse_json(c["metadata"])).alias("metadata")))
    payload = _text('{"component_card":', compact_card(card), ',"breadcrumbs":', F.to_json(crumb), ',"objectives":', F.to_json(F.coalesce(objectives, F.array().cast("array<string>"))), "}")
    section = focus_section(crumbs, F.get_json_object(card, "$.module_name"))
    return _text("# COMPONENT CONTEXT\n", payload, F.when(section != "", _text("\n\n", section)).otherwise(""), "\n\n# TASK\nPhase 1: name the pattern of the component (A registry, B workflow, C interface). Answer with JSON only.\n")


def catalogue(operators: Iterable[Callable]) -> list[tuple[str, str]]:
    """name and description of operators, from their names and docstrings."""
    return [(f.__name__, (f.__doc__ or "").strip()) for f in operators]


def normal_payload(card: Column, payload: Column) -> Column:
    """A card (JSON without the member, or with another) with its payload, or without one where that is null or empty."""
    bare = F.map_filter(F.from_json(card, "map<string,string>"), lambda k, v: k != "subagent_payload")
    full = F.when(F.coalesce(payload, F.lit("{}")).isin("{}", "null", ""), bare).otherwise(F.map_concat(bare, F.create_map(F.lit("subagent_payload"), payload)))
    return F.map_from_entries(F.array_sort(F.map_entries(full)))


def graph_dump(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, line: the members of a graph's dump as rows of JSON: nodes by id, edges by their ends, then what edges lead to and isn't there, sorted. Rows instead of one document, as a graph may be larger than a row."""
    one = lambda df, part, *by: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*by)).alias("key"), F.to_json(F.struct("*")).alias("line"))
    lost = edges.select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return one(nodes, "nodes", "id").unionByName(one(edges, "edges", "source", "target", "type")).unionByName(one(lost, "unresolved", "id")).orderBy("part", "key", "line").select("part", "line")
