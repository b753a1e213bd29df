"""Streams with state, committed tables, caches."""

import json
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.operators import catalog, commits
from graphloom.operators.response_cache import ResponseCache
from graphloom.streaming import state


def stream_of(spark, tmp_path, batches, schema):
    """A stream that reads one batch after the other."""
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_events_end_once_and_replays_write_once(spark, tmp_path):
    batches = [[(1, 0, "log", "a"), (1, 1, "log", "a"), (2, 0, "log", None), (2, 1, "log", "x")], [(1, 2, "log", "a"), (1, 3, "log", "b"), (2, 2, "error", "boom")], [(1, 4, "end", None), (1, 5, "log", "late"), (2, 3, "end", ""), (3, 0, "end", "")]]
    rows = state.progress_events(stream_of(spark, tmp_path, batches, "stream_id long, seq long, kind string, message string"))
    out, sink, seen = str(tmp_path / "out"), state.event_sink(str(tmp_path / "out")), []

    def twice(df, batch):
        kept = df.persist()
        sink(kept, batch)
        sink(kept, batch)
        seen.append(batch)

    state.run_available(rows, twice, str(tmp_path / "check"))
    got = sorted((r["stream_id"], r["seq"], json.loads(r["value"][6:])) for r in state.written(spark, out, "stream_id long, seq long, value string").collect())
    line = lambda s, m: {"status": s, "message": m}
    assert len(seen) == 3 and got == [(1, 0, line("analyzing", "a")), (1, 3, line("analyzing", "b")), (1, 4, line("complete", "")), (2, 1, line("analyzing", "x")), (2, 2, line("error", "boom")), (3, 0, line("complete", ""))]


def test_pushes_have_ids_of_their_own_and_expire(spark, tmp_path):
    at = datetime(2024, 1, 1)
    node = json.dumps({"node_key": "k", "title": "é", "action_parameters": {"a": 1}, "other": 2})
    first = state.crumbs_id("w", 0)
    batches = [[("w", 0, at, None, node)], [("w", 1, at + timedelta(minutes=59), first, node), ("w", 2, at + timedelta(minutes=60), first, node), ("v", 0, at, first, node)], [("w", 3, at + timedelta(minutes=61), first, node), ("w", 4, at + timedelta(minutes=61), "none", node)]]
    rows = state.breadcrumb_pushes(stream_of(spark, tmp_path, batches, "workspace string, seq long, at timestamp, cache_id string, node string"))
    out = str(tmp_path / "out")
    state.run_available(rows, state._once(out), str(tmp_path / "check"))
    got = {(r["workspace"], r["seq"]): r for r in state.written(spark, out, "workspace string, seq long, cache_id string, crumbs string, error string").collect()}
    one = {"node_key": "k", "title": "é", "node_type": None, "target_id": None, "metadata": {"action_parameters": {"a": 1}}}
    assert json.loads(got["w", 0]["crumbs"]) == [one] and json.loads(got["w", 1]["crumbs"]) == json.loads(got["w", 2]["crumbs"]) == [one, one]
    assert len({got["w", i]["cache_id"] for i in range(3)}) == 3
    assert [got[k]["error"] for k in (("v", 0), ("w", 3), ("w", 4))] == [f"Cache {first} not found or expired"] * 2 + ["Cache none not found or expired"]


def test_repeats_move_to_the_end(spark, tmp_path):
    batches = [[(1, 0, "a"), (1, 1, "b"), (2, 0, "a")], [(1, 2, "a")], [(1, 3, "c"), (1, 4, "b")]]
    rows = state.last_arrivals(stream_of(spark, tmp_path, batches, "stream_id long, seq long, message string"))
    out = str(tmp_path / "out")
    state.run_available(rows, state._once(out), str(tmp_path / "check"), "update")
    every = state.last_arrivals(state.written(spark, out, "stream_id long, message string, last_seen long").withColumn("seq", F.col("last_seen"))).orderBy("stream_id", "last_seen")
    assert [(r["stream_id"], r["message"]) for r in every.collect()] == [(1, "a"), (1, "c"), (1, "b"), (2, "a")]


# ---------------------------------------------------------------- commits


def test_half_a_save_is_not_seen(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}"
    nodes, edges = spark.range(3).selectExpr("cast(id as string) id"), spark.range(2).selectExpr("id source")
    assert catalog.save_graph(nodes, edges, path, "o/r é", None) == 1
    write = commits.write

    def broken(df, path, workspace, name, *more):
        if name == "edges":
            raise RuntimeError("lost")
        return write(df, path, workspace, name, *more)

    monkeypatch.setattr(commits, "write", broken)
    with pytest.raises(RuntimeError):
        catalog.save_graph(nodes.limit(1), edges.limit(1), path, "o/r é")
    n, e = catalog.load_graph(spark, path, "o/r é")
    assert (n.count(), e.count()) == (3, 2) and commits.versions(spark, path, "o/r é") == [1]
    monkeypatch.setattr(commits, "write", write)
    assert catalog.save_graph(nodes.limit(1), edges.limit(1), path, "o/r é") == 2
    assert catalog.load_graph(spark, path, "o/r é")[0].count() == 1 and catalog.load_graph(spark, path, "o/r é", 1)[0].count() == 3
    with pytest.raises(ValueError, match="there already"):
        catalog.save_graph(nodes, edges, path, "o/r é", 2)
    assert not catalog.graph_exists(spark, path, "none")
    with pytest.raises(ValueError, match="No call graph found"):
        catalog.load_graph(spark, path, "none")


def test_graph_cache_lets_the_oldest_go(spark, tmp_path):
    path = f"file://{tmp_path}"
    for i in range(9):
        catalog.save_graph(spark.range(i + 1).selectExpr("id"), spark.range(1).selectExpr("id source"), path, f"w{i}")
    cache = catalog.GraphCache()
    held = [cache.load(spark, path, f"w{i}")[0] for i in range(8)]
    assert cache.load(spark, path, "w0")[0] is held[0] and len(cache) == 8
    cache.load(spark, path, "w8")
    assert len(cache) == 8 and not held[1].is_cached and held[0].is_cached
    catalog.save_graph(spark.range(7), spark.range(1), path, "w0")
    assert cache.load(spark, path, "w0")[0].count() == 7
    cache.clear()
    assert len(cache) == 0 and not held[0].is_cached


def test_one_claim_wins_and_deletes_are_whole(spark, tmp_path):
    claims, data = f"file://{tmp_path}/claims", f"file://{tmp_path}/data"
    got = []
    threads = [threading.Thread(target=lambda i=i: got.append(catalog.get_or_create(spark, claims, "o", "r-x", f"b{i}"))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(made for _, made in got) == 1 and len({json.dumps(w, sort_keys=True) for w, _ in got}) == 1
    other, _ = catalog.get_or_create(spark, claims, "p", "q")
    tables = {n: spark.range(4).selectExpr("id", f"'{n}' AS name") for n in ("profiles", "nodes", "edges", "workflows")}
    for w in ("o-r-x", "p-q"):
        commits.save(tables, data, w)
    assert commits.everywhere(spark, data, "edges").count() == 8
    assert catalog.delete_workspace(spark, claims, data, "o", "r-x") and not catalog.delete_workspace(spark, claims, data, "o", "r-x")
    for n in tables:
        assert {r["workspace_id"] for r in commits.everywhere(spark, data, n).collect()} == {"p-q"}
        assert commits.load(spark, data, "p-q", n).count() == 4
    assert [r["workspace_id"] for r in catalog.list_workspaces(spark, claims).collect()] == ["p-q"] and catalog.get_workspace(spark, claims, "o", "r-x") is None
    assert commits.load(spark, data, "o-r-x", "nodes", 1).count() == 4


def test_writers_of_one_workspace_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}"
    threads = [threading.Thread(target=lambda i=i: commits.save({f"t{i}": spark.range(i + 1)}, path, "w")) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(commits.record(spark, path, "w")["tables"]) == [f"t{i}" for i in range(5)] and commits.versions(spark, path, "w") == [1, 2, 3, 4, 5]


def test_response_cache(spark, tmp_path):
    cache = ResponseCache(spark, f"file://{tmp_path}")
    day = lambda n: datetime(2024, 3, n)
    rows = lambda *x: spark.createDataFrame(list(x), "component_id string, crumbs array<string>, saved timestamp, body string")
    crumbs = F.array(F.lit("x"), F.lit("y"))
    assert cache.entries().count() == 0 and cache.clear_expired(F.lit(day(9))) == 0
    cache.save(rows(("a", ["x", "y"], day(1), "1"), ("a", [], day(2), "2"), ("b", ["x"], day(5), "3"), ("c", None, day(9), "4")))
    cache.save(rows(("a", ["x", "y"], day(3), "new")))
    body = lambda *a: [r["body"] for r in cache.get(*a).collect()]
    assert body("a", crumbs) == ["new"] and body("a", F.array().cast("array<string>")) == ["2"] and body("a", F.array(F.lit("no"))) == []
    assert body("a", crumbs, F.lit(day(10))) == ["new"] and body("a", crumbs, F.lit(day(11))) == []
    cache.clear("a", crumbs)
    assert body("a", crumbs) == [] and cache.entries().count() == 3
    cache.save(rows(("a", ["x", "y"], day(4), "again")))
    assert body("a", crumbs) == ["again"]
    assert cache.clear_expired(F.lit(day(11))) == 1 and sorted(r["body"] for r in cache.entries().collect()) == ["3", "4", "again"] and len(cache._segments()) == 1
    cache.clear("a")
    assert sorted(r["body"] for r in cache.entries().collect()) == ["3", "4"]
    for i in range(18):
        cache.save(rows(("d", [str(i % 3)], day(6), str(i))))
    assert len(cache._segments()) <= 16 and sorted(r["body"] for r in cache.entries().collect()) == ["15", "16", "17", "3", "4"]


def test_a_batch_of_pushes_asks_the_state_twice():
    from pyspark.sql import Row

    class Lists:
        """State of one workspace that counts what it is asked."""

        def __init__(self):
            self.rows, self.asked = {}, 0

        def __getattr__(self, name):
            def ask(*args):
                self.asked += 1
                if name == "appendList":
                    self.rows |= {r[0]: r for r in args[0]}
                elif name == "updateValue":
                    self.rows[args[0][0]] = (*args[0], *args[1])
                elif name == "get":
                    return iter(self.rows.values())
                elif name == "containsKey":
                    return args[0][0] in self.rows
                elif name == "getValue":
                    return self.rows[args[0][0]][1:] if args[0][0] in self.rows else None

            return ask

    lists = Lists()
    handle = type("Handle", (), {"getListState": lambda *a: lists, "getMapState": lambda *a: lists})()
    crumbs, at = state._Crumbs(3600), datetime(2024, 1, 1)
    crumbs.init(handle)
    for some in (range(20), range(20, 40)):
        rows = [Row(workspace="w", seq=i, at=at, cache_id=state.crumbs_id("w", i - 1) if i else None, node=json.dumps({"title": f"t{i}"})) for i in reversed(some)]
        asked, got = lists.asked, list(crumbs.handleInputRows(("w",), iter(rows), None))
        assert [len(json.loads(r["crumbs"])) for r in got] == [i + 1 for i in some] and lists.asked - asked <= 2


def test_state_of_events_comes_with_their_rows():
    import pandas as pd

    class State:
        exists, hasTimedOut, get, removed = False, False, None, False

        def update(self, x):
            self.exists, self.get = True, x

        def setTimeoutDuration(self, ms):
            self.ms = ms

        def remove(self):
            self.removed = True

    held, frame = State(), lambda *rows: pd.DataFrame(list(rows), columns=["stream_id", "seq", "kind", "message"])
    run = lambda *frames: [r for f in state._events((1,), iter(frames), held, 5000) for r in f["seq"]]
    assert run(frame((1, 2, "log", "a"), (1, 1, "log", None)), frame((1, 0, "log", "a"))) == [0] and held.ms == 5000
    assert run(frame((1, 3, "log", "a"), (1, 4, "end", None), (1, 5, "log", "b"))) == [4] and run(frame((1, 6, "end", ""))) == []
    held.hasTimedOut = True
    assert run() == [] and held.removed
