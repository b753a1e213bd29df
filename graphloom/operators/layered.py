"""Layered layout of many graphs at once, from left to right: cycles broken, longest-path layers, fewer crossings by barycentre sweeps, positions.

Every step is a join or a window over all graphs together. Graphs of up to WHOLE nodes and edges are dealt over tasks once, each whole, and a step over them shuffles nothing: ROUNDS layers are taken in one job, by
windows over the rows of a graph. Those of larger graphs are joined by node, over all tasks, with a round of jobs for each layer of the longest graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.storage import dealt, settle, settle_dealt

# ---- Fixed values: node width and least height, height of a further line of text and characters of a line, padding, gaps between nodes of a layer and between layers, margin.
NODE_W, BASE_H, LINE_H, LINE_CHARS, PAD_H = 500, 90, 20, 54, 12
NODE_SEP, RANK_SEP, MARGIN = 180, 450, 60
SWEEPS = 6
#: Nodes and edges of a graph that one task holds whole, and nodes and edges of a task.
WHOLE, DEALT = 100_000, 500_000
#: Layers that the first job over whole graphs takes, and the most that a later one takes; each takes twice as many as the one before.
ROUNDS = (2, 4)

Keep = Callable[[DataFrame], DataFrame]


def layers(nodes: DataFrame, edges: DataFrame, keep: Keep = settle, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(graph, node, position, layer and what else nodes have) and the edges without cycles (graph, source, target). nodes: graph, node, position; edges: graph, source, target.
    A node's layer is the length of the longest path that leads to it. Where all that is left of a graph lies on or behind cycles, the edges into its first node by position are turned round. Loops, repeats
    and edges to nodes that aren't there are left out; a node without a name or graph has no edges. Every table on the way is kept by `keep`. tasks: each graph is whole in one of so many."""
    peeled = partial(_peeled_whole, tasks=tasks) if tasks else _peeled
    known = keep(nodes.dropDuplicates(["graph", "node"]))
    ends = known.select("graph", "node")
    live = edges.select("graph", "source", "target").filter("source <> target").distinct()
    live = keep(live.join(ends.withColumnRenamed("node", "source"), ["graph", "source"], "left_semi").join(ends.withColumnRenamed("node", "target"), ["graph", "target"], "left_semi"))
    placed, kept, turned = peeled(known, live, keep)
    return peeled(known, keep(kept), keep)[:2] if turned else (placed, kept)  # a node that waited on a cycle may lie further back without it


def _peeled(known: DataFrame, live: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes by the round in which nothing led to them any more, the edges in the directions that they have then, and whether some were turned."""
    unnamed = F.col("graph").isNull() | F.col("node").isNull()
    left, layer = known.filter(~unnamed), 0
    placed, kept = [known.filter(unnamed).withColumns({"_cut": F.lit(False), "layer": F.lit(0)})], [live.limit(0)]
    while not left.isEmpty():
        entered = live.select("graph", F.col("target").alias("node")).distinct()
        free = left.join(entered, ["graph", "node"], "left_anti")
        stuck = left.join(free.select("graph").distinct(), "graph", "left_anti")
        first = F.row_number().over(Window.partitionBy("graph").orderBy("position", "node"))
        freed = stuck.withColumn("_n", first).filter("_n = 1").drop("_n")
        now = keep(free.withColumn("_cut", F.lit(False)).unionByName(freed.withColumn("_cut", F.lit(True))))
        placed.append(now.withColumn("layer", F.lit(layer)))
        here = now.select("graph", "node")
        into = here.withColumnRenamed("node", "target").withColumn("_in", F.lit(True))
        out = here.withColumnRenamed("node", "source").withColumn("_out", F.lit(True))
        # an edge into a freed node is turned round; what leaves this layer is settled
        turned = live.join(into, ["graph", "target"], "left").select("graph", F.when(F.col("_in"), F.col("target")).otherwise(F.col("source")).alias("source"), F.when(F.col("_in"), F.col("source")).otherwise(F.col("target")).alias("target")).distinct()
        marked = keep(turned.join(out, ["graph", "source"], "left"))
        kept.append(marked.filter("_out").drop("_out"))
        live = marked.filter("_out is null").drop("_out")
        left = keep(left.join(here, ["graph", "node"], "left_anti"))
        layer += 1
    every = _all(placed)
    return every.drop("_cut"), _all(kept), not every.filter("_cut").isEmpty()


def _peeled_whole(known: DataFrame, live: DataFrame, keep: Keep, tasks: int) -> tuple[DataFrame, DataFrame, bool]:
    """_peeled() of graphs that lie whole in a task each, several rounds in a job: nodes (without `to`) and edges are rows of one table, and a row has a layer once it is settled."""
    rows = known.unionByName(live.withColumnsRenamed({"source": "node", "target": "to"}), allowMissingColumns=True).repartition(tasks, "graph").withColumns({"_told": F.coalesce("to", "node"), "_cut": F.lit(False), "layer": F.lit(None).cast("int")})
    done, layer, more, waits, turned = [], 0, ROUNDS[0], True, False
    while waits:
        for k in range(layer, layer + more):
            rows = _round(rows, k)
        rows = keep(rows)
        done.append(rows.filter("layer is not null"))
        waits, cut = rows.agg(F.max(F.col("layer").isNull()), F.max("_cut")).first()
        rows, turned = rows.filter("layer is null"), turned or bool(cut)
        layer, more = layer + more, min(2 * more, ROUNDS[1])
    placed = _all([x.filter("to is null").drop("to", "_told", "_cut") for x in done])
    kept = _all([x.filter("to is not null").select("graph", F.col("node").alias("source"), F.col("to").alias("target")).distinct() for x in done])
    return placed, kept, turned


def _round(rows: DataFrame, layer: int) -> DataFrame:
    """Nodes that nothing leads to any more and the edges that leave them get this layer; in a graph without such a node its first one by position does, and the edges into it are turned round. _told: the node that
    a row tells of, itself or the target."""
    told, graph = Window.partitionBy("graph", "_told"), Window.partitionBy("graph")
    waits, rank = F.col("layer").isNull(), F.struct("position", "node")
    node, edge = waits & F.col("to").isNull(), waits & F.col("to").isNotNull()
    seen = rows.withColumn("_free", node & ~F.max(edge).over(told)).withColumns({"_any": F.max("_free").over(graph), "_first": F.min(F.when(node, rank)).over(graph)})
    freed = node & ~F.col("_any") & rank.eqNullSafe(F.col("_first"))
    seen = seen.withColumns({"_freed": freed, "_turn": edge & F.max(freed).over(told)})
    source, target = (F.when(F.col("_turn"), F.col(a)).otherwise(F.col(b)) for a, b in (("to", "node"), ("node", "to")))
    leaves = F.max(F.col("_free") | F.col("_freed")).over(Window.partitionBy("graph", source))
    new = {"node": source, "to": target, "_told": F.coalesce(target, source), "_cut": F.col("_cut") | F.col("_freed"), "layer": F.when(waits & leaves, F.lit(layer)).otherwise(F.col("layer"))}
    return seen.select(*(new[c].alias(c) if c in new else c for c in rows.columns))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def places(placed: DataFrame, edges: DataFrame, sweeps: int = SWEEPS, keep: Keep = settle, tasks: int | None = None) -> DataFrame:
    """graph, node, layer, place (from 1) and what else placed has but position: an order of each layer with few crossings. Edges over several layers pass through a helper in each; a sweep orders a layer by
    the mean place of the neighbours in the layer before it, the next one by those in the layer after it; of all sweeps the order whose edges climb least is kept, graph by graph."""
    rest = [c for c in placed.columns if c not in ("graph", "node", "layer", "position")]
    at = lambda end, *more: placed.select("graph", F.col("node").alias(end), F.col("layer").alias(f"{end}_layer"), *more)
    spans = edges.join(at("source", "position"), ["graph", "source"]).join(at("target"), ["graph", "target"])
    real = F.struct(F.col("node"), F.lit(None).cast(placed.schema["node"].dataType).alias("to"), F.lit(None).cast("int").alias("step"))
    point = lambda i: F.when(i == F.col("source_layer"), F.struct(F.col("source").alias("node"), F.lit(None).cast(placed.schema["node"].dataType).alias("to"), F.lit(None).cast("int").alias("step"))).when(i == F.col("target_layer"), F.struct(F.col("target").alias("node"), F.lit(None).cast(placed.schema["node"].dataType).alias("to"), F.lit(None).cast("int").alias("step"))).otherwise(F.struct(F.col("source").alias("node"), F.col("target").alias("to"), i.cast("int").alias("step")))
    hops = keep(spans.withColumn("i", F.explode(F.sequence(F.col("source_layer"), F.col("target_layer") - 1))).select("graph", F.col("i").alias("layer"), "position", point(F.col("i")).alias("a"), point(F.col("i") + 1).alias("b")))
    helpers = hops.filter("a.to is not null").select("graph", "layer", F.col("a").alias("p"), "position")
    every = placed.select("graph", "layer", real.alias("p"), "position", *rest).unionByName(helpers, allowMissingColumns=True)
    every = every.repartition(tasks, "graph") if tasks else every
    rank = lambda *by: F.row_number().over(Window.partitionBy("graph", "layer").orderBy(*by)).cast("double")
    order = keep(every.withColumn("place", rank("position", F.col("p.node"), F.col("p.to"))).drop("position").withColumn("tried", F.array("place")))
    for s in range(1, sweeps + 1):
        mine, other = ("b", "a") if s % 2 else ("a", "b")
        neighbour = order.select("graph", F.col("p").alias(other), F.col("place").alias("_at"))
        pull = hops.join(neighbour, ["graph", other]).groupBy("graph", F.col(mine).alias("p")).agg(F.avg("_at").alias("_mean"))
        moved = order.join(pull, ["graph", "p"], "left").withColumn("_mean", F.coalesce("_mean", "place"))
        order = keep(moved.withColumn("place", rank("_mean", "place")).drop("_mean").withColumn("tried", F.concat("tried", F.array("place"))))
    # all orders are weighed in one pass; of equal ones the first is taken
    end = lambda x: order.select("graph", F.col("p").alias(x), F.col("tried").alias(f"_{x}"))
    climb = F.array(*(F.sum(F.abs(F.col("_a")[i] - F.col("_b")[i])) for i in range(sweeps + 1)))
    climbed = hops.join(end("a"), ["graph", "a"]).join(end("b"), ["graph", "b"]).groupBy("graph").agg(climb.alias("climb"))
    best = keep(climbed.select("graph", F.array_position("climb", F.array_min("climb")).cast("int").alias("best")))
    # helpers only hold room in the order
    mine = keep(order.filter("p.to is null").join(best, "graph", "left").withColumn("place", F.element_at("tried", F.coalesce("best", F.lit(1)))).drop("best", "tried"))
    return mine.withColumn("place", rank("place").cast("int")).select("graph", F.col("p.node").alias("node"), "layer", "place", *rest)


def layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, node, layer, place, x, y (of the upper left corner): nodes have graph, node, position, description. Layers stand side by side, each centred on the tallest of its graph."""
    spark = nodes.sparkSession
    nodes, edges = settle(nodes.select("graph", "node", "position", "description")), settle(edges.select("graph", "source", "target"))
    size = nodes.select("graph").union(edges.select("graph")).groupBy("graph").count()
    is_large = (F.col("count") > WHOLE) & F.col("graph").isNotNull()
    rows, some = size.agg(F.sum(F.when(~is_large, F.col("count"))), F.max(is_large)).first()
    if not some:
        few, many = (nodes, edges), None
    else:
        large = settle(size.filter(is_large).select("graph"))
        few, many = (tuple(x.join(large, "graph", how) for x in (nodes, edges)) for how in ("left_anti", "left_semi"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(rows or 0) // DEALT))
    with dealt(spark):
        deal = lambda df: settle_dealt(df, "graph", tasks)
        out = _laid(*(deal(x.repartition(tasks, "graph")) for x in few), deal, tasks)
    return out if many is None else out.unionByName(_laid(*many, settle))


def _laid(nodes: DataFrame, edges: DataFrame, keep: Keep, tasks: int | None = None) -> DataFrame:
    lines = F.greatest(F.ceil(F.length(F.coalesce("description", F.lit(""))) / LINE_CHARS) - 1, F.lit(0))
    placed, kept = layers(nodes.select("graph", "node", "position", (BASE_H + lines * LINE_H + PAD_H).alias("h")), edges, keep, tasks)
    tall = places(keep(placed), keep(kept), keep=keep, tasks=tasks)
    before = Window.partitionBy("graph", "layer").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    stacked = keep(tall.withColumn("above", F.coalesce(F.sum(F.col("h") + NODE_SEP).over(before), F.lit(0))))
    height = keep(stacked.groupBy("graph", "layer").agg((F.sum("h") + NODE_SEP * (F.count(F.lit(1)) - 1)).alias("height")))
    most = height.groupBy("graph").agg(F.max("height").alias("most"))
    # nodes without a graph are all in one layer, the tallest
    got = stacked.join(height, ["graph", "layer"], "left").join(most, "graph", "left").withColumn("down", F.coalesce((F.col("most") - F.col("height")) / 2, F.lit(0)))
    return keep(got.select("graph", "node", "layer", "place", (MARGIN + F.col("layer") * (NODE_W + RANK_SEP)).cast("double").alias("x"), (MARGIN + F.col("down") + F.col("above")).cast("double").alias("y")))
