"""Paths against an exhaustive walk, on graphs whose levels don't fit at once."""

import random

import pytest

from graphloom.operators import graph


def plain(edges, start, ends, depth, most):
    out = []

    def walk(path, types):
        if path[-1] in ends:
            out.append((path, types))
        if len(types) < depth:
            for s, t, k in edges:
                if s == path[-1] and t not in path:
                    walk([*path, t], [*types, k])

    walk([start], [])
    return sorted(out, key=lambda x: (len(x[0]), x[0], x[1]))[:most]


def test_dense_graphs_to_depth_eight(spark, monkeypatch):
    r = random.Random(3)
    names = [f"n{i}" for i in range(9)]
    edges = [(a, b, k) for a in names for b in names if a != b for k in ("CALLS", "USES") if r.random() < (0.55 if k == "CALLS" else 0.06)]
    # far: reached by long paths only, past a dense part
    edges += [("n0", "t1", "CALLS"), ("t1", "t2", "CALLS"), ("t2", "far", "USES"), ("n1", "island", "CALLS")]
    df = spark.createDataFrame(edges, "source string, target string, type string")
    nodes = spark.createDataFrame([(n,) for n in {x for e in edges for x in e[:2]}], "id string")
    sizes, settle = [], graph.settle

    def watched(x):
        got = settle(x)
        if x.columns == ["start", "at", "path"]:
            sizes.append(got.count())
        return got

    for level, most, depth in ((100_000, 25, 8), (60, 12, 5)):
        sizes.clear()
        monkeypatch.setattr(graph, "LEVEL", level)
        monkeypatch.setattr(graph, "settle", watched)
        got = graph.find_paths(df, ["n3", "gone", "n5"], ["far", "n4", "n5"], max_depth=depth, max_paths=most, nodes=nodes).collect()
        assert [(x["start"], x["error"]) for x in got if x["error"]] == [("gone", "Node does not exist.")]
        for s in ("n3", "n5"):
            mine = [(x["path"], x["types"]) for x in got if x["start"] == s]
            assert sorted(mine, key=lambda x: (len(x[0]), x[0], x[1])) == plain(edges, s, {"far", "n4", "n5"}, depth, most)
        assert max(sizes) <= max(level, 2 * len(names))
    with pytest.raises(ValueError):
        graph.find_paths(df, [" "], ["n1"])


def test_prefix_and_histograms(spark):
    rows = [("a", 0.5, "A", "class", "", "./src/app/x/a.py"), ("b", 0.3, "B", "class", "model", "src\\app\\x\\b.py".replace("\\", "/")), ("c", 0.2, "C", None, "", "src/app/y/c.py"), ("d", 0.1, "D", "file", "", "src/app/z.py"), ("e", 0.1, "E", "file", "", None)]
    df = spark.createDataFrame(rows, "id string, score double, label string, kind string, category string, file_path string")
    assert graph.common_prefix(df) == 2 and graph.common_prefix(df.filter("id in ('a', 'b')")) == 3 and graph.common_prefix(df.limit(0)) == 0
    clean = df.filter("id in ('b', 'c', 'd')")
    got = {r["directory"]: r for r in graph.directory_components(clean).collect()}
    assert set(got) == {"x", "y"} and got["x"]["kinds"] == {"class": 1} and got["x"]["categories"] == {"model": 1} and got["y"]["kinds"] is None and got["y"]["categories"] is None


def test_all_edges_are_written_as_they_come(spark, monkeypatch):
    edges = [("a", "b", "calls"), ("a", "b", "CALLS"), ("a", "b", "USES"), ("b", "c", "CALLS"), ("b", "c", "CALLS"), ("x", "y", "CALLS")]
    plans, settle = [], graph.settle

    def watched(x):
        plans.append((x.columns, x._jdf.queryExecution().executedPlan().toString()))
        return settle(x)

    monkeypatch.setattr(graph, "settle", watched)
    got = graph.find_paths(spark.createDataFrame(edges, "source string, target string, type string"), ["a"], ["c"], max_depth=3).collect()
    assert sorted((r["path"], r["types"]) for r in got) == [(["a", "b", "c"], ["CALLS", "CALLS"]), (["a", "b", "c"], ["USES", "CALLS"])]
    assert plans[0][0] == ["source", "target", "type"] and "Exchange" not in plans[0][1]
