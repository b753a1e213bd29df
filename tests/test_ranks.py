"""Ranks by steps over the core of a graph against steps over all of its edges."""

import random

from graphloom.operators import graph


def plain_ranks(ids, edges, damping=0.85, tolerance=1e-6):
    total, score = {}, {x: 1 / len(ids) for x in ids}
    for s, _, w in edges:
        total[s] = total.get(s, 0) + w
    while True:
        loose = sum(score[x] for x in ids if not total.get(x))
        new = dict.fromkeys(ids, (1 - damping) / len(ids) + damping * loose / len(ids))
        for s, t, w in edges:
            if total[s]:
                new[t] += damping * score[s] * w / total[s]
        change = sum(abs(new[x] - score[x]) for x in ids)
        score = new
        if change < tolerance:
            return score


def ranked(spark, ids, edges):
    e = spark.createDataFrame([(s, t, "CALLS", float(w)) for s, t, w in edges], "source string, target string, type string, weight double")
    return {r["id"]: r["score"] for r in graph.pagerank(spark.createDataFrame([(x,) for x in ids], "id string"), e).collect()}


def test_ranks_with_and_without_a_core(spark, monkeypatch):
    draw = random.Random(4)
    ids = [f"n{i}" for i in range(60)]
    roots = {(f"n{draw.randrange(20)}", f"n{draw.randrange(30, 60)}"): draw.randrange(4) for _ in range(90)}
    core = roots | {(f"n{a}", f"n{b}"): draw.randrange(1, 4) for a, b in [(30, 31), (31, 32), (32, 30), (33, 34), (35, 35), (25, 33)]}
    tables = []
    monkeypatch.setattr(graph, "settle", lambda df, f=graph.settle: tables.append(1) or f(df))
    for shape, most in ((roots, 6), (core, 120)):
        edges, before = [(s, t, w) for (s, t), w in shape.items()], len(tables)
        got, want = ranked(spark, ids, edges), plain_ranks(ids, edges)
        assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in ids) < 1e-12
        assert len(tables) - before <= most  # where nothing enters the sources, steps write no table
