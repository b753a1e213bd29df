"""Validated documents, messages and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import title_case

# ---- Fixed values: the grid's columns, node width and height, gaps between nodes and layers, left margin, height of a layer's label.
COLUMNS = 3
NODE_W, NODE_H, GAP_X, GAP_Y, LAYER_GAP = 260, 120, 140, 100, 180
START_X, LABEL_H = 40, 60


def group_by_layer(components: DataFrame, order: list[str]) -> DataFrame:
    """layer, rank, components: layers in their order; what is in none comes last, as Other."""
    if not order:
        return components.groupBy(F.lit("Components").alias("layer"), F.lit(0).alias("rank")).agg(F.array_join(F.sort_array(F.collect_list("component")), ",").alias("components"), F.count(F.lit(1)).alias("n"))
    ranks = components.sparkSession.createDataFrame(list(enumerate(order)), "rank int, name string")
    got = components.join(F.broadcast(ranks), components["layer"] == ranks["name"], "left")
    return got.groupBy(F.coalesce("name", F.lit("Other")).alias("layer"), F.coalesce("rank", F.lit(len(order))).alias("rank")).agg(F.array_join(F.sort_array(F.collect_list("component")), ",").alias("components"), F.count(F.lit(1)).alias("n"))


def grid(components: DataFrame) -> DataFrame:
    """x and y of each component (component, rank): three a row under their layer's label, layers one under the other."""
    i = F.row_number().over(Window.partitionBy("rank").orderBy("component")) - 1
    placed = components.withColumn("i", i)
    height = LABEL_H + F.ceil(F.count(F.lit(1)) / COLUMNS) * (NODE_H + GAP_Y) + LAYER_GAP
    layers = placed.groupBy("rank").agg(height.alias("height"))
    top = layers.withColumn("top", F.coalesce(F.sum("height").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per layer
    x, y = START_X + F.col("i") % COLUMNS * (NODE_W + GAP_X), F.col("top") + LABEL_H + F.floor(F.col("i") / COLUMNS) * (NODE_H + GAP_Y)
    return placed.join(F.broadcast(top), "rank").select("component", "rank", x.cast("long").alias("x"), y.cast("long").alias("y"))


def layer_totals(groups: DataFrame) -> DataFrame:
    """layers and components in all of group_by_layer()'s rows."""
    return groups.agg(F.count(F.lit(1)).alias("layers"), F.coalesce(F.sum("n"), F.lit(0)).alias("components"))


def layer_label(layer: Column, rank: Column, layers: int) -> Column:
    """A layer's name in title case; what is in none is Other."""
    return F.when(rank < layers, title_case(layer)).otherwise("Other")


def edge_offsets(edges: DataFrame) -> DataFrame:
    """(i - (n - 1) / 2) * 20 among the edges of a source."""
    w = Window.partitionBy("source")
    i, n = F.row_number().over(w.orderBy("target")) - 1, F.count(F.lit(1)).over(w)
    return edges.withColumn("offset", ((i - (n - 1) / 2) * 20).cast("double"))


def changed(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before (null-safe); the first of each key stays."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).withColumn("_p", F.lag(value).over(w)).filter((F.col("_n") == 1) | ~F.col("_p").eqNullSafe(F.col(value))).drop("_n", "_p")


def missing_fields(have: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(r) for r in required]), have)


def steps(workflow: Column) -> Column:
    """steps (or key_steps) of a workflow document, numbered again, with defaults."""
    a = F.from_json(F.get_json_object(workflow, "$.steps"), "array<string>")
    b = F.from_json(F.get_json_object(workflow, "$.key_steps"), "array<string>")
    return F.transform(F.coalesce(a, b, F.array().cast("array<string>")), lambda s, i: F.struct((i + 1).alias("order"), F.coalesce(F.get_json_object(s, "$.title"), s).alias("title")))


def usage_totals(calls: DataFrame, key: str, prompt: str, completion: str) -> DataFrame:
    from graphloom.functions.scalars import token_cost

    got = calls.groupBy(key).agg(F.sum(prompt).alias("prompt"), F.sum(completion).alias("completion"))
    return got.select(key, "prompt", "completion", (F.col("prompt") + F.col("completion")).alias("total"), token_cost(F.col("prompt"), F.col("completion")).alias("cost"))


def vertical(nodes: DataFrame, key: str, sequential: bool) -> DataFrame:
    """y of each node (key, position, description) of a column: under the estimated heights of those before, from 60."""
    height = 90 + F.greatest(F.lit(0), F.ceil(F.length("description") / 54) - 1) * 20 + 12
    before = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("y", (F.lit(60) + F.coalesce(F.sum(height + (90 if sequential else 70)).over(before), F.lit(0))).cast("long"))


def next_edges(nodes: DataFrame, key: str, node: str = "node_key") -> DataFrame:
    """source, target: from each node of a sequence to the one after it; nodes without a position are left out."""
    w = Window.partitionBy(key).orderBy("position")
    return nodes.filter("position is not null").select(F.col(node).alias("source"), F.lead(node).over(w).alias("target")).filter("target is not null")


def layer_colors(components: DataFrame, colors: int = 8) -> DataFrame:
    """layer, color: by first appearance (the least position), in turn."""
    first = components.groupBy(F.coalesce(F.nullif("layer", F.lit("")), F.lit("other")).alias("layer")).agg(F.min("position").alias("first"))
    return first.select("layer", ((F.row_number().over(Window.orderBy("first")) - 1) % colors).cast("int").alias("color"))  # one row per layer


def flow_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges (source, target, position) whose ends both exist, with their offset: spread around the middle where a source or a target has several."""
    ids = components.select(F.col("component").alias("_id")).distinct()
    good = edges.join(ids, F.col("source") == F.col("_id"), "left_semi").join(ids, F.col("target") == F.col("_id"), "left_semi")
    s, t = Window.partitionBy("source"), Window.partitionBy("target")
    n, m = F.count(F.lit(1)).over(s), F.count(F.lit(1)).over(t)
    i = F.row_number().over(s.orderBy("position", "target")) - 1
    return good.withColumn("offset", F.when((n > 1) | (m > 1), (i - (n - 1) / 2) * 20).otherwise(0.0).cast("double"))


def usage_since(calls: DataFrame, key: str, order: str, tokens: str, checkpoint: Column) -> DataFrame:
    """key, current, session: tokens since the checkpoint and in all."""
    return calls.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col(order) >= checkpoint, F.col(tokens))), F.lit(0)).alias("current"), F.sum(tokens).alias("session"))
