"""Point lookups, node summaries, the subgraph of an anchor with its fallbacks, inheritance around a class, attribute filters."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import graph


def source_code(profiles: DataFrame, node: str) -> DataFrame:
    """code, start_line, end_line, file_path of one profile, or one row with an error."""
    wanted = node.strip()
    if not wanted:
        raise ValueError("node_id cannot be blank")
    one = profiles.sparkSession.createDataFrame([(wanted,)], "wanted string")
    got = profiles.filter(F.col("id") == wanted).select("id", F.col("source_code").alias("code"), "start_line", "end_line", "file_path")
    return one.join(got, F.col("wanted") == F.col("id"), "left").select("code", "start_line", "end_line", "file_path", F.when(F.col("id").isNull(), F.concat(F.lit("not found: "), "wanted")).alias("error"))


def calls_of(profiles: DataFrame, node: str) -> DataFrame:
    """The calls of one profile, in order; none if it is missing."""
    return profiles.filter(F.col("id") == node).select(F.posexplode("calls").alias("position", "call"))


def entry_candidates(profiles: DataFrame, wanted: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The ids that workflows are made for: all or the wanted ones, by id."""
    got = profiles.select("id") if wanted is None else profiles.select("id").filter(F.col("id").isin(wanted))
    return got.orderBy("id") if limit is None else got.orderBy("id").limit(limit)


def picked_component(cards: DataFrame, choices: DataFrame) -> DataFrame:
    """choice, component_id: for each choice (group, choice) the card (group, component_id, position) that has it as its id, else the card at that place, counted from 1; null if there is neither."""
    placed = cards.withColumn("_n", F.row_number().over(Window.partitionBy("group").orderBy("position")).cast("string"))
    by_id = placed.select("group", F.col("component_id").alias("choice"), F.col("component_id").alias("_id")).dropDuplicates(["group", "choice"])
    by_place = placed.select("group", F.col("_n").alias("choice"), F.col("component_id").alias("_at"))
    return choices.join(by_id, ["group", "choice"], "left").join(by_place, ["group", "choice"], "left").select("group", "choice", F.coalesce("_id", "_at").alias("component_id"))


def matching(rows: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Rows whose attributes all match: text compares in any case, a list means one of, None means null; a column that isn't there matches nothing."""

    def one(name: str, want: object) -> Column:
        if name not in rows.columns:
            return F.lit(False)
        if want is None:
            return F.col(name).isNull()
        some = want if isinstance(want, (list, tuple, set)) else [want]
        return F.lower(F.col(name).cast("string")).isin(*[str(x).lower() for x in some if x is not None])

    return rows.filter(reduce(lambda a, b: a & b, [one(k, v) for k, v in filters.items()], F.lit(True)))


def snapshots(ids: DataFrame, nodes: DataFrame, profiles: DataFrame) -> DataFrame:
    """id, label, kind, category, file_path of ids (a column id): from the graph, else from the profile; ids of neither are left out."""
    n = nodes.select(F.col("id"), F.struct("label", "kind", S.category(F.col("category"), F.col("kind")).alias("category"), "file_path").alias("n"))
    name = F.concat(F.coalesce("class_name", F.lit("")), F.when(F.col("class_name").isNotNull() & F.col("function_name").isNotNull(), ":").otherwise(""), F.coalesce("function_name", "class_name", F.lit("unknown")))
    p = profiles.select("id", F.struct(name.alias("label"), "kind", F.lit("implementation").alias("category"), "file_path").alias("p"))
    return ids.join(n, "id", "left").join(p, "id", "left").withColumn("x", F.coalesce("n", "p")).filter("x is not null").select("id", "x.*")


def with_summaries(nodes: DataFrame, profiles: DataFrame, include_source: bool = False) -> DataFrame:
    """nodes with line_range, summary, where it is from, and has_source."""
    p = profiles.select(
        F.col("id").alias("_id"), F.concat_ws("-", "start_line", "end_line").alias("line_range"), F.when(F.trim("docstring") != "", "docstring").otherwise("inferred").alias("summary_source"),
        S.short_or_inferred(*(F.col(c) for c in ("docstring", "kind", "class_name", "function_name", "parameters", "file_path", "start_line"))).alias("summary"),
        (S.shorten(F.trim("source_code"), 500, "...") if include_source else F.lit(None).cast("string")).alias("source_snippet"),
    )
    got = nodes.join(p, F.col("id") == F.col("_id"), "left")
    return got.withColumns({"has_source": F.col("_id").isNotNull(), "summary": F.coalesce("summary", F.concat(F.coalesce("kind", F.lit("unknown")), F.lit(" node (no profile record)"))), "summary_source": F.coalesce("summary_source", F.lit("graph_only"))}).drop("_id")


def subgraph(nodes: DataFrame, edges: DataFrame, profiles: DataFrame, anchor: str, max_depth: int = 2, max_nodes: int = 30, include_source: bool = False) -> tuple[DataFrame, DataFrame, str | None]:
    """Nodes with summaries, edges, and a note. An anchor that the graph lacks falls back to its own profile, if it is a method, then to its class in the graph."""
    parts = anchor.removeprefix("python::").split("::")
    method = anchor.startswith("python::") and len(parts) >= 3
    note = None
    if nodes.filter(F.col("id") == anchor).isEmpty():
        if method and not profiles.filter(F.col("id") == anchor).isEmpty():
            own = profiles.filter(F.col("id") == anchor).select("id", F.lit(parts[2]).alias("label"), F.lit("method").alias("kind"), F.lit("method").alias("category"), "file_path", F.lit(True).alias("is_anchor"))
            return with_summaries(own, profiles, include_source), edges.limit(0).select("source", "target", "type"), "from the profile: not in the call graph"
        parent = f"python::{parts[0]}::{parts[1]}" if method else None
        if parent is None or nodes.filter(F.col("id") == parent).isEmpty():
            raise ValueError(f"{anchor!r} is neither in the graph nor a profile")
        anchor, note = parent, f"{parts[2]!r} is not in the call graph: its class {parts[1]!r} instead"
    found, used = graph.expand(edges, anchor, max_depth, max_nodes)
    rows = found.join(nodes, "id", "left").select("id", "label", "kind", S.category(F.col("category"), F.col("kind")).alias("category"), "file_path", (F.col("id") == anchor).alias("is_anchor"))
    return with_summaries(rows, profiles, include_source), used, note


def inheritance(nodes: DataFrame, edges: DataFrame, scope: str = "", target: str | None = None, kind: str = "class") -> DataFrame:
    """role (target or dominant, parent, child), id, label: around the first scoped class whose id contains the name, else around the one most inherited from."""
    scoped = nodes.filter(F.col("file_path").contains(scope) & (F.col("kind") == kind))
    if target:
        one = scoped.filter(F.col("id").contains(target)).orderBy("id").limit(1).select("id")
    else:
        one = graph.dominant_base(nodes, edges, scope, kind).select("id")
    up = graph.of_types(edges, ("INHERITS_FROM",)).select("source", "target").distinct()
    parents = up.join(F.broadcast(one), up["source"] == one["id"]).select(F.lit("parent").alias("role"), F.col("target").alias("id"))  # one row
    children = up.join(F.broadcast(one), up["target"] == one["id"]).select(F.lit("child").alias("role"), F.col("source").alias("id"))
    every = one.select(F.lit("target" if target else "dominant").alias("role"), "id").unionByName(parents).unionByName(children)
    return every.join(nodes.select("id", "label"), "id", "left").select("role", "id", "label")


#: Folders and names that a trace leaves out.
OUT_PATHS, OUT_NAMES = ("/utils/", "/helpers/", "/common/"), r"^(_|log_.*|.*_validator$)"


def clean_trace(trace: DataFrame, profiles: DataFrame) -> DataFrame:
    """position, id: a trace without helpers, private names and ids that have no profile; its start stays."""
    p = profiles.select(F.col("id"), F.col("file_path"), S.first_given(F.col("function_name"), F.col("class_name"), F.col("id")).alias("name"))
    bad = reduce(lambda a, b: a | b, [F.coalesce("file_path", F.lit("")).contains(x) for x in OUT_PATHS]) | F.col("name").rlike(OUT_NAMES)
    return trace.join(p, "id", "left").filter((F.col("position") == 0) | (F.col("name").isNotNull() & ~bad)).select("position", "id")
