"""Layered layouts: layers against longest paths, crossings against a count of all pairs of edges."""

import random

from pyspark.sql import functions as F

from graphloom.operators import layered

N, E = "graph int, node string, position int, description string", "graph int, source string, target string"


def crossings(edges, layer, place):
    """Pairs of edges between neighbouring layers that cross."""
    near = [(place[a], place[b], layer[a]) for a, b in edges if layer[b] == layer[a] + 1]
    return sum((a < c and b > d) or (a > c and b < d) for i, (a, b, k) in enumerate(near) for c, d, m in near[:i] if k == m)


def test_layers_and_crossings(spark):
    r = random.Random(5)
    nodes, edges = [], []
    for g in range(12):
        names = [f"n{i}" for i in range(r.randint(4, 10))]
        nodes += [(g, n, i, "x" * r.randint(0, 200)) for i, n in enumerate(r.sample(names, len(names)))]
        order = r.sample(names, len(names))
        pairs = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if r.random() < 0.22}
        if g % 3 == 2:  # cycles
            pairs |= {(b, a) for a, b in list(pairs)[:2]} | {(order[-1], order[0])}
        edges += [(g, a, b) for a, b in pairs] + [(g, names[0], names[0]), (g, names[0], "gone")]
    nodes += [(90, a, i, None) for i, a in enumerate("abcdef")] + [(91, "alone", 0, "")]
    edges += [(90, "a", "f"), (90, "b", "e"), (90, "c", "d"), (90, "a", "f")]
    df, links = spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)
    placed, kept = layered.layers(df, links)
    at = {(x["graph"], x["node"]): x["layer"] for x in placed.collect()}
    acyclic = {(x["graph"], x["source"], x["target"]) for x in kept.collect()}
    assert len(at) == len(nodes)
    ends = {(x[0], x[1]) for x in nodes}
    for g, a, b in {e for e in edges if e[1] != e[2] and (e[0], e[2]) in ends}:
        assert ((g, a, b) in acyclic) + ((g, b, a) in acyclic) == 1
        if g % 3 != 2 or g > 80:
            assert (g, a, b) in acyclic
    for (g, n), k in at.items():  # one more than the furthest of those that lead to it
        assert k == max([at[g, a] + 1 for h, a, b in acyclic if (h, b) == (g, n)], default=0)
    got = layered.layout(df, links).collect()
    assert len(got) == len(nodes)
    place, first = {(x["graph"], x["node"]): x["place"] for x in got}, {}
    for x in sorted(nodes, key=lambda x: x[2]):
        first[x[0], x[1]] = 1 + sum((x[0], at[x[0], x[1]]) == (h, at[h, m]) for h, m in first)
    count = lambda p: sum(crossings([((g, a), (g, b)) for g, a, b in acyclic if g == k], at, p) for k in {x[0] for x in nodes})
    assert crossings([((90, a), (90, b)) for a, b in ("af", "be", "cd")], at, place) == 0
    assert count(place) < 0.8 * count(first)
    tall = {(g, n): 102 + 20 * max(0, -(-len(t or "") // 54) - 1) for g, n, _, t in nodes}
    for x in got:
        g, k = x["graph"], x["layer"]
        mine = sorted((y["place"], y["y"], tall[g, y["node"]]) for y in got if (y["graph"], y["layer"]) == (g, k))
        assert x["x"] == 60 + 950 * k and [p for p, _, _ in mine] == list(range(1, len(mine) + 1)) and all(b[1] == a[1] + a[2] + 180 for a, b in zip(mine, mine[1:], strict=False))
        assert min(y["y"] for y in got if y["graph"] == g) == 60
    assert layered.layout(df.limit(0), links).count() == 0 and layered.layout(df, links.filter(F.lit(False))).filter("layer > 0").count() == 0


def test_dealt_graphs_shuffle_nothing_and_large_ones_come_out_alike(spark, monkeypatch):
    r = random.Random(8)
    nodes = [(g, f"n{i}", r.randint(0, 9), "x" * r.randint(0, 90)) for g in range(3) for i in range(3 + 2 * g)]
    edges = [(0, "n0", "n1"), (1, "n0", "n1"), (1, "n1", "n2"), (1, "n0", "n2"), (2, "n0", "n1"), (2, "n0", "n2"), (2, "n1", "n3"), (2, "n0", "n3"), (2, "n4", "n5"), (2, "n5", "n6")]
    df, links = spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)
    kept, keep = [], layered.settle_dealt

    def watched(x, key, tasks):
        kept.append(x._jdf.queryExecution().executedPlan().toString())
        return keep(x, key, tasks)

    monkeypatch.setattr(layered, "settle_dealt", watched)
    monkeypatch.setattr(layered, "DEALT", 5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # large tables
    try:
        whole = layered.layout(df, links).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the two inputs are dealt; of the steps after them only those over tables put together shuffle
    moved = [p for p in kept[2:] if "Exchange" in p]
    assert len(kept) > 20 and len(moved) <= 4 and all("Union" in p for p in moved)
    monkeypatch.setattr(layered, "WHOLE", 12)
    assert sorted(layered.layout(df, links).collect()) == sorted(whole)


def test_layers_of_whole_graphs_are_taken_several_in_a_job_and_come_out_as_by_joins(spark, monkeypatch):
    r = random.Random(3)
    nodes = [(g, f"n{i}", r.randint(0, 5), "x" * r.randint(0, 90)) for g in range(5) for i in range(6 + g)] + [(50, f"n{i:02}", i, "") for i in range(12)]
    edges = [(g, f"n{r.randint(0, 5 + g)}", f"n{r.randint(0, 5 + g)}") for g in range(5) for _ in range(9)] + [(0, "n0", "n1"), (0, "n1", "n0")]  # cycles too
    edges += [(50, f"n{i:02}", f"n{i + 1:02}") for i in range(11)] + [(50, "n00", "n07")]
    df, links = spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)
    short = df.filter("graph = 50"), links.filter("graph = 50")
    kept, keep = [], layered.settle_dealt
    monkeypatch.setattr(layered, "settle_dealt", lambda *a: kept.append(a) or keep(*a))
    at = {x["node"]: x["layer"] for x in layered.layout(*short).collect()}
    assert at == {f"n{i:02}": i for i in range(12)} and len(kept) < 30  # a round of jobs for each of the twelve layers were 55
    whole = sorted(layered.layout(df, links).collect())
    assert len(whole) == len(nodes)
    monkeypatch.setattr(layered, "WHOLE", 1)
    assert sorted(layered.layout(df, links).collect()) == whole


def test_nodes_without_a_graph_or_a_name_have_no_edges(spark):
    df = spark.createDataFrame([(1, "a", 0, "t"), (1, "b", 1, None), (1, None, 2, "t"), (None, "a", 0, "t"), (None, "b", 1, "t"), (None, None, 0, None)], N)
    links = spark.createDataFrame([(1, "a", "b"), (1, None, "b"), (1, "a", None), (None, "a", "b")], E)
    want = {(1, "a"): 0, (1, "b"): 1, (1, None): 0, (None, "a"): 0, (None, "b"): 0, (None, None): 0}
    assert {(x["graph"], x["node"]): x["layer"] for x in layered.layout(df, links).collect()} == want
    assert {(x["graph"], x["node"]): x["layer"] for x in layered.layers(df, links)[0].collect()} == want
