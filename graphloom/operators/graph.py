"""Graph operators over nodes(id, kind, category, label, file_path) and edges(source, target, type, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import category
from graphloom.operators.storage import settle

#: What a category multiplies a rank by.
MULTIPLIERS = {"service": 4.0, "controller": 3.5, "model": 2.2, "data_pipeline": 0.65, "integration": 0.5, "sdk": 0.5, "infrastructure": 0.4, "utility": 0.35, "test": 0.0, "external": 0.0, "implementation": 1.0, "unknown": 1.0}
PATH_TYPES = ("CALLS", "USES", "DATA_ACCESS")


def of_types(edges: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """Edges whose upper-cased type is wanted; no types: all."""
    return edges.filter(F.upper("type").isin(*[t.upper() for t in types])) if types else edges


def weighted(edges: DataFrame) -> DataFrame:
    """One edge per pair: CALLS only, parallel weights summed; negatives count 0, what is no number counts 1."""
    w = F.greatest(F.coalesce(F.expr("try_cast(weight AS DOUBLE)"), F.lit(1.0)), F.lit(0.0))
    return of_types(edges, ("CALLS",)).groupBy("source", "target").agg(F.sum(w).alias("weight"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, most: int = 100, tolerance: float = 1e-6, fixed: int | None = None) -> DataFrame:
    """id, score. Jacobi steps from 1/N; the mass of nodes without outgoing weight is spread evenly; stops when the summed change is
    under the tolerance, or after `fixed` steps.

    Nodes that nothing enters all have one score b, so what their edges bring a node is b times a number that stays, w: a node that only they enter has base + w * damping * b, and a step over such nodes is
    a sum over w, without a join, a shuffle or a table. Only edges whose source is entered itself (core) are joined in each step, with the nodes at their ends; such a step is one more job that writes those
    nodes' ranks, which cuts lineage; the change and the mass to spread are observed while it writes."""
    e = settle(weighted(edges))
    total = settle(e.groupBy("source").agg(F.sum("weight").alias("total")))
    out, none = total.filter("total > 0"), total.filter("total <= 0")
    step = settle(e.join(out, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("p")))
    w = settle(step.groupBy("target").agg(F.sum("p").alias("w")))
    entered = settle(out.join(w, out["source"] == w["target"], "left_semi").select("source"))
    ids = nodes.select("id").union(total.select("source")).union(w.select("target")).union(e.join(none, "source", "left_semi").select("target")).distinct()
    core = None
    if not entered.isEmpty():
        core = settle(step.join(entered, "source", "left_semi"))
        w = step.join(entered, "source", "left_anti").groupBy("target").agg(F.sum("p").alias("w"))
    every = ids.join(out.select(F.col("source").alias("id"), F.lit(False).alias("d")), "id", "left").join(w.withColumnRenamed("target", "id"), "id", "left")
    every = every.select("id", F.coalesce("d", F.lit(True)).alias("dangling"), F.coalesce("w", F.lit(0.0)).alias("w"))
    if core is None:
        plain, active = settle(every), None
    else:
        ends = core.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("core", F.lit(True))
        split = settle(every.join(ends, "id", "left"))
        plain, active = split.filter("core is null").drop("core"), split.filter("core").drop("core")
    count, held, weight = plain.agg(F.count(F.lit(1)), F.count_if("dangling"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("w"))), F.lit(0.0))).first()
    more = active.agg(F.count(F.lit(1)), F.count_if("dangling")).first() if active is not None else (0, 0)
    n = count + more[0]
    if not n:
        return plain.select("id", F.lit(0.0).alias("score"))
    # the score of a plain node is base + w * slope
    base, slope, loose = 1.0 / n, 0.0, (held + more[1]) / n
    rank = active.withColumn("score", F.lit(base)) if active is not None else None
    for _ in range(fixed or most):
        new_base, new_slope = (1 - damping) / n + damping * loose / n, damping * base
        change = 0.0 if fixed else plain.agg(F.sum(F.abs(F.lit(new_base - base) + F.col("w") * (new_slope - slope)))).first()[0] or 0.0
        loose = new_base * held + new_slope * weight
        if rank is not None:
            # shares and old scores meet in one aggregate
            shares = core.join(rank.select("id", "score"), F.col("source") == F.col("id")).select(F.col("target").alias("id"), (F.col("p") * F.col("score")).alias("got"), F.lit(None).cast("double").alias("old"), F.lit(None).cast("boolean").alias("dangling"), F.lit(None).cast("double").alias("w"))
            both = shares.union(rank.select("id", F.lit(0.0), "score", "dangling", "w")).groupBy("id").agg(F.sum("got").alias("got"), F.max("old").alias("old"), F.max("dangling").alias("dangling"), F.max("w").alias("w"))
            new = both.select("id", "dangling", "w", (F.lit(new_base) + F.col("w") * new_slope + damping * F.col("got")).alias("score"), "old")
            seen = Observation()
            watched = new.observe(seen, F.sum(F.abs(F.col("score") - F.col("old"))).alias("change"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0)).alias("loose"))
            rank = settle(watched).drop("old")
            change, loose = change + (seen.get["change"] or 0.0), loose + seen.get["loose"]
        base, slope = new_base, new_slope
        if not fixed and change < tolerance:
            break
    scored = plain.select("id", (F.lit(base) + F.col("w") * slope).alias("score"))
    return scored if rank is None else scored.union(rank.select("id", "score"))


def adjusted(rank: DataFrame, nodes: DataFrame) -> DataFrame:
    """Scores times their category's multiplier, those not above 0 dropped, summing to 1; unadjusted if none is left."""
    table = F.create_map(*[F.lit(x) for kv in MULTIPLIERS.items() for x in kv])
    cat = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.nullif(F.col("kind"), F.lit("")), F.lit("external"))
    marked = rank.join(nodes, "id", "left").withColumn("category", cat).withColumn("adjusted", F.col("score") * F.coalesce(F.try_element_at(table, F.col("category")), F.lit(1.0)))
    total = marked.agg(F.sum("adjusted"), F.sum("score")).first()  # two numbers
    if not total[0]:
        return marked.withColumn("score", F.col("score") / (total[1] or 1.0)).drop("adjusted")
    return marked.filter("adjusted > 0").withColumn("score", F.col("adjusted") / total[0]).drop("adjusted")


def rank_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 10, fixed: int | None = None) -> DataFrame:
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    return adjusted(pagerank(nodes, edges, fixed=fixed), nodes).orderBy(F.desc("score"), "id").limit(limit).select("id", "score", "label", "kind", "category", "file_path")


def neighbors(edges: DataFrame, node: str, types: tuple[str, ...] = ()) -> DataFrame:
    return of_types(edges, types).filter(F.col("source") == node).select(F.col("target").alias("neighbor"), F.upper("type").alias("type"))


def edge_bundles(edges: DataFrame, node: str, direction: str = "out", types: tuple[str, ...] = ()) -> DataFrame:
    if direction not in ("out", "in"):
        raise ValueError("direction must be out or in")
    here, there = ("source", "target") if direction == "out" else ("target", "source")
    got = of_types(edges, types).filter(F.col(here) == node).groupBy(F.col(there).alias("neighbor"))
    return got.agg(F.sort_array(F.collect_set(F.upper("type"))).alias("types"), F.sum(F.greatest(F.coalesce(F.expr("try_cast(weight AS DOUBLE)"), F.lit(0.0)), F.lit(0.0))).alias("weight"))


#: Paths of a level that are walked at once.
LEVEL = 200_000


def _walks(pairs: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """node, left: from the node a walk of so many steps leads to a goal."""
    front = settle(goals.select("node", F.lit(0).alias("left")))
    every = front
    for i in range(1, most + 1):
        front = settle(pairs.join(front, pairs["target"] == front["node"]).select(pairs["source"].alias("node"), F.lit(i).alias("left")).distinct())
        if front.isEmpty():
            break
        every = every.unionByName(front)
    return every


def find_paths(edges: DataFrame, start: list[str], end: list[str], types: tuple[str, ...] = PATH_TYPES, max_depth: int = 8, max_paths: int = 25, nodes: DataFrame | None = None) -> DataFrame:
    """start, end, depth, path, types, error: simple outgoing paths, at most max_paths per start, shortest first, then by path and types. A path goes on past a target; a start that is a target has a path of length 0;
    parallel edges of several types give a path each. With `nodes`, a start that the graph lacks has one row with an error.

    Paths grow level by level, only where what is left of the depth can still reach a target, and a start that has max_paths shorter ones is done. When the next level would exceed LEVEL paths,
    the lengths that are left are taken one by one: prefixes in order of path, a piece of them at a time to the full length, until the starts have their paths or no prefix is left. So no level is larger than LEVEL, or
    one node's edges, and the paths are the same."""
    start, end = list(dict.fromkeys(x.strip() for x in start if x.strip())), list(dict.fromkeys(x.strip() for x in end if x.strip()))
    if not start or not end:
        raise ValueError("starts and ends are needed")
    if not 1 <= max_depth <= 20 or not 1 <= max_paths <= 200:
        raise ValueError("max_depth is 1 to 20, max_paths 1 to 200")
    spark = edges.sparkSession
    # all edges are written once, as they come; repeats go where few are left
    every = settle(of_types(edges, types or PATH_TYPES).select("source", "target", F.upper("type").alias("type")))
    goals = spark.createDataFrame([(x,) for x in end], "node string")
    first = spark.createDataFrame([(x, x, [x]) for x in start], "start string, at string, path array<string>")
    errors = None
    if nodes is not None:
        there = nodes.select(F.col("id").alias("start"))
        errors = first.join(there, "start", "left_anti").select("start", F.lit("Node does not exist.").alias("error"))
        first = first.join(there, "start", "left_semi").select(first.columns)
    walks = settle(_walks(every, goals, max_depth))
    near = walks.groupBy("node").agg(F.min("left").alias("least"))
    typed = settle(every.join(near, every["target"] == near["node"]).select("source", "target", "type", "least").distinct())
    reaching = settle(typed.select("source", "target", "least").distinct())
    pairs = reaching.select("source", "target")  # every edge of a path leads to a node from which a goal is reached
    found, have = [], dict.fromkeys(start, 0)

    def keep(level: DataFrame) -> list[str]:
        """Add the paths that end here at a target; the starts that still want some."""
        hits = settle(level.join(F.broadcast(goals), F.col("at") == F.col("node"), "left_semi").withColumn("_n", _order("path")).filter(F.col("_n") <= max_paths).drop("_n"))
        found.append(hits)
        for s, n in hits.groupBy("start").count().collect():  # starts that were asked for
            have[s] += n
        return [s for s in start if have[s] < max_paths]

    def grown(level: DataFrame, by: DataFrame) -> DataFrame:
        return level.join(by, level["at"] == by["source"]).filter(~F.array_contains("path", F.col("target"))).select("start", F.col("target").alias("at"), F.array_append("path", F.col("target")).alias("path"))

    level, wide = settle(first), None
    for depth in range(max_depth + 1):
        open_ = keep(level)
        if depth == max_depth or not open_:
            break
        level = level.filter(F.col("start").isin(open_))
        by = reaching.filter(F.col("least") <= max_depth - depth - 1).select("source", "target")
        if (level.join(by, level["at"] == by["source"]).limit(LEVEL + 1).count()) > LEVEL:
            wide = depth + 1
            break
        level = settle(grown(level, by))
        if level.isEmpty():
            break
    if wide is not None:
        degree = pairs.groupBy("source").count().agg(F.max("count")).first()[0]
        piece = max(1, LEVEL // (degree * len(start)))
        for length in range(wide, max_depth + 1):
            waiting = [(0, first)]
            while waiting and (open_ := [s for s in start if have[s] < max_paths]):
                at, rows = waiting.pop()
                rows = rows.filter(F.col("start").isin(open_))
                if at == length:
                    keep(rows)
                    continue
                placed = rows.withColumn("_n", _order("path"))
                rest = settle(placed.filter(F.col("_n") > piece).drop("_n"))
                if not rest.isEmpty():
                    waiting.append((at, rest))
                goal = walks.filter(F.col("left") == length - at - 1).select("node")
                more = settle(grown(placed.filter(F.col("_n") <= piece).drop("_n"), pairs.join(goal, pairs["target"] == goal["node"], "left_semi")))
                if not more.isEmpty():
                    waiting.append((at + 1, more))
    paths = found[0]
    for f in found[1:]:
        paths = paths.unionByName(f)
    out = _with_types(paths, typed, max_paths)
    place = F.row_number().over(Window.partitionBy("start").orderBy(F.size("path"), F.array_join("path", "\0"), F.array_join("types", "\0")))
    out = out.withColumn("n", place).filter(F.col("n") <= max_paths).select("start", F.col("at").alias("end"), (F.size("path") - 1).alias("depth"), "path", "types", F.lit(None).cast("string").alias("error"))
    return out if errors is None else out.unionByName(errors, allowMissingColumns=True)


def _order(path: str) -> Column:
    """Place among a start's paths, which are of one length."""
    return F.row_number().over(Window.partitionBy("start").orderBy(F.array_join(path, "\0")))


def _with_types(paths: DataFrame, typed: DataFrame, most: int) -> DataFrame:
    """Each path as often as its hops' types combine, the first `most` combinations in order."""
    hops = paths.select("start", "at", "path", F.posexplode(F.sequence(F.lit(0), F.size("path") - 2)).alias("_", "i")).filter("size(path) > 1").select("start", "at", "path", "i", F.get("path", F.col("i")).alias("source"), F.get("path", F.col("i") + 1).alias("target"))
    kinds = typed.groupBy("source", "target").agg(F.sort_array(F.collect_set("type")).alias("kinds"))
    listed = hops.join(kinds, ["source", "target"]).groupBy("start", "at", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "kinds"))), lambda x: x["kinds"]).alias("hops"))
    begin = F.array(F.array().cast("array<string>"))
    ways = F.aggregate("hops", begin, lambda acc, ks: F.slice(F.flatten(F.transform(acc, lambda a: F.transform(ks, lambda k: F.array_append(a, k)))), 1, most))
    none = paths.filter("size(path) = 1").select("start", "at", "path", F.array().cast("array<string>").alias("types"))
    return none.unionByName(listed.select("start", "at", "path", F.explode(ways).alias("types")))


def expand(edges: DataFrame, anchor: str, max_depth: int = 2, max_nodes: int = 30) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) reached from the anchor over edges in either direction, and the edges of the nodes expanded. The next level takes nodes in id
    order up to the cap."""
    if not 1 <= max_depth <= 5 or not 5 <= max_nodes <= 100:
        raise ValueError("max_depth is 1 to 5, max_nodes 5 to 100")
    spark = edges.sparkSession
    seen, front, used = [anchor], [anchor], []
    rows = [(anchor, 0)]
    for d in range(1, max_depth + 1):
        if not front or len(seen) >= max_nodes:
            break
        touching = edges.filter(F.col("source").isin(front) | F.col("target").isin(front))  # at most max_nodes names
        used.append(touching)
        other = F.explode(F.array("source", "target")).alias("id")
        new = touching.select(other).filter(~F.col("id").isin(seen)).distinct().orderBy("id").limit(max_nodes - len(seen))
        front = [r["id"] for r in new.collect()]  # at most max_nodes
        seen += front
        rows += [(x, d) for x in front]
    out = used[0] if used else edges.limit(0)
    for u in used[1:]:
        out = out.union(u)
    return spark.createDataFrame(rows, "id string, depth int"), out.select("source", "target", "type").distinct().withColumn("endpoint_in_subgraph", F.col("source").isin(seen) & F.col("target").isin(seen))


def bases(nodes: DataFrame, edges: DataFrame, scope: str = "", kind: str = "class") -> DataFrame:
    """Scoped classes with the number of edges INHERITS_FROM that enter them."""
    scoped = nodes.filter(F.col("file_path").contains(scope) & (F.col("kind") == kind)) if scope else nodes.filter(F.col("kind") == kind)
    count = of_types(edges, ("INHERITS_FROM",)).groupBy("target").agg(F.count(F.lit(1)).alias("children"))
    return scoped.join(count, scoped["id"] == count["target"], "left").select("id", "label", "file_path", F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def dominant_base(nodes: DataFrame, edges: DataFrame, scope: str = "", kind: str = "class") -> DataFrame:
    top = bases(nodes, edges, scope, kind).orderBy(F.desc("children"), "id").limit(1)
    return top.select("id", F.col("children").alias("inheritance_depth"), F.when(F.col("children") >= 2, "Plugin Architecture").otherwise("Class Hierarchy").alias("pattern"))


def trace(edges: DataFrame, start: str, max_depth: int = 5, most: int = 1_000_000) -> DataFrame:
    """position, id: pre-order walk over CALLS with one visited set, targets by id. The part of the graph within the depth is found level by level in tables, and walked on
    the driver; if that part has over `most` edges, this raises instead of leaving some out."""
    calls = of_types(edges, ("CALLS",)).select("source", "target").distinct()
    spark = calls.sparkSession
    seen = front = spark.createDataFrame([(start,)], "node string")
    found = []
    for _ in range(max_depth - 1):
        level = settle(calls.join(front, calls["source"] == front["node"], "left_semi"))
        found.append(level)
        front = settle(level.select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    out: dict[str, list[str]] = {}
    if sum(level.count() for level in found) > most:
        raise ValueError(f"the trace has over {most} edges: lower max_depth")
    for level in found:
        for r in sorted(level.collect()):
            out.setdefault(r["source"], []).append(r["target"])
    order, visited, stack = [], set(), [(start, 1)]
    while stack:
        x, d = stack.pop()
        if x in visited:
            continue
        visited.add(x)
        order.append(x)
        if d < max_depth:
            stack.extend((y, d + 1) for y in reversed(out.get(x, [])))
    return spark.createDataFrame(list(enumerate(order)), "position long, id string")


def _folders(path: Column) -> Column:
    """The folders of a path; what leads it of dots and slashes doesn't count."""
    parts = F.filter(F.split(F.regexp_replace(F.translate(path, "\\", "/"), "^[./]+", ""), "/"), lambda x: (x != "") & (x != "."))
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def common_prefix(nodes: DataFrame) -> int:
    """How many leading folders all paths share."""
    parts = nodes.filter(F.coalesce("file_path", F.lit("")) != "").select(_folders(F.col("file_path")).alias("p"))
    least = parts.agg(F.min(F.size("p")), F.count(F.lit(1))).first()
    if not least[1] or not least[0]:
        return 0
    places = parts.select(F.posexplode(F.slice("p", 1, least[0])).alias("pos", "name")).groupBy("pos").agg(F.min("name") == F.max("name"))
    same = {r[0]: r[1] for r in places.collect()}  # at most as many as the shortest path has folders
    return next((i for i in range(least[0]) if not same[i]), least[0])


def directories(scored: DataFrame, depth: int = 1, limit: int = 20, per_dir: int = 5, skip: int = 0) -> DataFrame:
    """directory, avg_score, total_score, n, kinds, categories, top: folders at a depth below `skip` folders that all share, best mean first, with how many nodes are of each kind and category (unknown ones
    left out) and their best nodes."""
    parts = F.split("file_path", "/")
    d = F.when(F.size(parts) > skip + depth, F.array_join(F.slice(parts, skip + 1, depth), "/"))
    placed = scored.withColumn("directory", d).filter(F.col("directory").isNotNull())
    stats = placed.groupBy("directory").agg(F.round(F.avg("score"), 9).alias("avg_score"), F.round(F.sum("score"), 9).alias("total_score"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("directory").orderBy(F.desc(F.round("score", 9)), "id"))
    best = placed.withColumn("r", place).filter(F.col("r") <= per_dir).groupBy("directory").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), ",").alias("top"))
    out = stats.join(best, "directory")
    for name, column in (("kinds", F.nullif("kind", F.lit(""))), ("categories", category(F.col("category"), F.col("kind")))):
        each = placed.withColumn("_v", column).filter("_v is not null and _v <> 'unknown'").groupBy("directory", "_v").agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(each.groupBy("directory").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias(name)), "directory", "left")  # as many as there are kinds
    return out.orderBy(F.desc("avg_score"), "directory").limit(limit)


def directory_components(ranked: DataFrame, depth: int = 1, limit: int = 20, per_dir: int = 5) -> DataFrame:
    """directories() of ranked nodes, below the folders that all their paths share."""
    return directories(ranked, depth, limit, per_dir, common_prefix(ranked))
