import math

import pytest
from pyspark.sql import functions as F

from graphloom import registry
from graphloom.functions import scalars as S
from graphloom.operators import documents, graph, link, text
from graphloom.sources import python_source as P

E = "source string, target string, type string, weight string"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, t, w) for a, b, t, w in rows], E)


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, kind string, category string, label string, file_path string")


def test_pagerank_equals_dense_iteration(spark):
    e = edges(spark, [("a", "b", "CALLS", "2"), ("a", "c", "calls", None), ("b", "c", "CALLS", "x"), ("c", "a", "CALLS", "-4"), ("d", "d", "CALLS", "1"), ("a", "d", "USES", "9")])
    n = nodes(spark, [(x, "function", "", x, f"src/{x}.py") for x in "abcd"])
    got = {r["id"]: r["score"] for r in graph.pagerank(n, e, tolerance=1e-3).collect()}
    w = {("a", "b"): 2 / 3, ("a", "c"): 1 / 3, ("b", "c"): 1.0, ("d", "d"): 1.0}  # c has no weight left: it dangles
    rank = dict.fromkeys("abcd", 0.25)
    for _ in range(100):
        loose = rank["c"]
        new = {x: 0.15 / 4 + 0.85 * (sum(rank[a] * p for (a, b), p in w.items() if b == x) + loose / 4) for x in "abcd"}
        change, rank = sum(abs(new[x] - rank[x]) for x in "abcd"), new
        if change < 1e-3:
            break
    assert all(math.isclose(got[x], rank[x], abs_tol=1e-12) for x in "abcd") and math.isclose(sum(got.values()), 1)


def test_paths_are_simple_bounded_and_pass_targets(spark):
    e = edges(spark, [("a", "b", "CALLS", None), ("b", "c", "CALLS", None), ("a", "c", "USES", None), ("c", "a", "CALLS", None), ("c", "d", "CALLS", None), ("a", "b", "USES", None)])
    got = graph.find_paths(e, ["a", "zz"], ["c", "d", "a"], max_depth=3).collect()
    paths = [(r["path"], r["types"]) for r in got]
    assert (["a"], []) in paths and (["a", "c"], ["USES"]) in paths and (["a", "b", "c", "d"], ["USES", "CALLS", "CALLS"]) in paths
    assert all(len(set(p)) == len(p) and len(p) <= 4 for p, _ in paths) and len(paths) == 1 + 3 + 3
    with pytest.raises(ValueError):
        graph.find_paths(e, ["a"], ["b"], max_depth=21)


def test_expansion_stops_at_the_cap(spark):
    e = edges(spark, [("a", f"n{i:02}", "CALLS", None) for i in range(20)])
    n, used = graph.expand(e, "a", 2, 5)
    assert [r["id"] for r in n.orderBy("depth", "id").collect()] == ["a", "n00", "n01", "n02", "n03"]
    assert used.filter("endpoint_in_subgraph").count() == 4


def test_trace_is_preorder_with_one_visited_set(spark):
    e = edges(spark, [("a", "b", "CALLS", None), ("a", "c", "CALLS", None), ("b", "d", "CALLS", None), ("c", "d", "CALLS", None), ("d", "a", "CALLS", None)])
    assert [r["id"] for r in graph.trace(e, "a", 3).orderBy("position").collect()] == ["a", "b", "d", "c"]


SOURCE = '''import os
from . import sibling
from ..pkg import thing as t
from x import *

@deco
class A(Base, mod.Other):
    """Doc."""
    class Inner:
        def deep(self): return helper_call(1)
    @app.get("/items", methods=["post"])
    async def go(self, x: List[int], *args, y=1, **kw) -> Out:
        self.other(); json.dumps(x); A()
        def inner(): hidden()
if True:
    def skipped(): pass
def top(): return A().go(unknown.call(1))
'''


def test_extraction(spark):
    df = spark.createDataFrame([("svc/a.py", SOURCE.encode()), ("svc/bad.py", b"def ("), ("svc/bytes.py", b"\xff\xfe")], "path string, content binary")
    got = {r["id"]: r for r in P.extract(df).collect()}
    assert set(got) == {"python::file::svc/a.py", "python::svc/a.py::A", "python::svc/a.py::A::Inner", "python::svc/a.py::A::Inner::deep", "python::svc/a.py::A::go", "python::svc/a.py::top", "python::file::svc/bad.py", "python::file::svc/bytes.py"}
    go = got["python::svc/a.py::A::go"]
    assert go["kind"] == "method" and go["parameters"] == ["self", "x", "*args", "y", "**kw"] and go["start_line"] == 11
    assert "hidden" not in go["calls"] and {"self.other", "json.dumps", "A"} <= set(go["calls"])
    assert {u["symbol"] for u in go["uses"]} >= {"app.get", "List", "Out"} and [b["symbol"] for b in got["python::svc/a.py::A"]["inheritance"]] == ["Base", "mod.Other"]
    assert [(i["module"], i["name"]) for i in got["python::file::svc/a.py"]["import_sites"]] == [("os", None), ("svc", "sibling"), ("pkg", "thing")]
    assert got["python::file::svc/bad.py"]["error"].startswith("SyntaxError") and got["python::file::svc/bytes.py"]["error"].startswith("UnicodeDecodeError")


def test_linking_fans_out_by_alias(spark):
    df = spark.createDataFrame([("m.py", "class Foo:\n    def run(self): pass\nclass B(Foo): pass\ndef f():\n    Foo()\n    ext.call()\n    self.x()\n")], "path string, content string")
    n, e = link.build(P.extract(df))
    got = {(r["source"].split("::")[-1], r["target"].split("::")[-1], r["type"]) for r in e.collect()}
    assert {("f", "Foo", "USES"), ("f", "run", "CALLS"), ("B", "Foo", "INHERITS_FROM"), ("B", "run", "INHERITS_FROM"), ("f", "ext.call", "CALLS"), ("f", "self.x", "CALLS")} <= got
    assert e.groupBy("source", "target", "type").count().filter("count > 1").count() == 0
    _, s = link.build(P.extract(df), strict=True)
    assert s.filter("type = 'INHERITS_FROM'").count() == 1 and n.filter("kind = 'external_call'").count() == 2


def test_entry_points_and_models(spark):
    src = "from fastapi import APIRouter\nclass V:\n    @router.post('/b')\n    def b(self): pass\n@router.websocket(path='/a')\ndef a(): 'doc'\n@router.get(PREFIX + '/c')\ndef c(): pass\n"
    got = P.entry_points(spark.createDataFrame([("api/r.py", src)], "path string, content string"), P.extract(spark.createDataFrame([("api/r.py", src)], "path string, content string"))).collect()
    assert [(r["route"], r["http_methods"], r["framework"], r["label"]) for r in got] == [("/a", ["WEBSOCKET"], "fastapi", "a"), ("/b", ["POST"], "fastapi", "V.b"), ("PREFIX + '/c'", ["GET"], "fastapi", "c")]
    assert all(r["profile_id"] for r in got)
    m = "class M(Base):\n    name = models.CharField('n', max_length=3)\n    class Meta:\n        table = 't'\nclass E: pass\n"
    rows = P.core_models(P.extract(spark.createDataFrame([("db/m.py", m), ("x/m.py", m)], "path string, content string"))).orderBy("id").collect()
    assert [(r["model_name"], len(r["fields"])) for r in rows] == [("E", 0), ("M", 1), ("M.Meta", 0)] and rows[1]["fields"][0]["args"] == ["'n'", "max_length=3"] and rows[1]["meta"] == {"table": "'t'"}


def test_search_context_and_literals(spark):
    f = spark.createDataFrame([("a.py", "one\ntwo(\nthree"), ("venv/b.py", "two("), ("c.bin", "two(")], "path string, content string")
    got = text.search(f, "two(", 1).collect()
    assert [(r["path"], r["line"]) for r in got] == [("a.py", 2)] and got[0]["context"] == "   1     one\n   2 >>> two(\n   3     three"
    assert [r["path"] for r in text.scan(f, ["*.py"]).collect()] == ["a.py"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert tuple(one(S.parse_id(F.lit("python::a/b.py::A::B::go")))) == ("a/b.py", "A.B", "go")
    assert tuple(one(S.parse_id(F.lit("python::file::a.py")))) == ("a.py", None, None)
    assert one(S.breadcrumb_key(F.array().cast("array<string>"))) == "root"
    assert tuple(one(S.github_parts(F.lit("https://github.com/o-w/r.git")))) == ("o-w", "r", None)
    assert tuple(one(S.github_parts(F.lit("https://github.com/o/r/tree/dev/x")))) == ("o", "r", "dev")
    assert one(S.json_in_text(F.lit('so: ```json\n{"a": {"b": 1}}\n``` end'))) == '{"a": {"b": 1}}' and one(S.json_in_text(F.lit("none"))) is None
    assert one(S.last_token(F.lit("a.b::c"))) == "c" and one(S.title_case(F.lit("data-PIPE"))) == "Data Pipe"
    assert one(link.category(F.lit("latest/x.py"), F.lit(None), F.lit("f"))) == "test" and one(link.category(F.lit("api/x.py"), F.lit(None), F.lit("get"))) == "controller"
    assert one(S.size_text(F.lit(256))) == "0.2 KB" and one(S.size_text(F.lit(1572864))) == "1.5 MB" and one(S.comma_list(F.lit(" a , ,b"))) == ["a", "b"]
    assert [r["title"] for r in one(documents.steps(F.lit('{"key_steps": ["a", {"title": "b"}]}')))] == ["a", "b"]


class State:
    hasTimedOut, exists, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutDuration(self, ms):
        self.ms = ms

    def remove(self):
        self.exists = False


def test_stream_step_suppresses_runs_across_batches():
    import pandas as pd

    from graphloom.streaming.progress import suppress

    state, frame = State(), lambda rows: pd.DataFrame(rows, columns=["stream_id", "seq", "message"])
    first = list(suppress((1,), [frame([(1, 2, "a"), (1, 1, "a")]), frame([(1, 3, "b")])], state, 5))[0]
    second = list(suppress((1,), [frame([(1, 4, "b"), (1, 5, None), (1, 6, None), (1, 7, "a")])], state, 5))[0]
    assert first["seq"].tolist() == [1, 3] and second["seq"].tolist() == [5, 7] and state.ms == 5
    state.hasTimedOut = True
    assert not list(suppress((1,), [], state, 5)) and not state.exists


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 30


def test_stream_of_two_batches_equals_one_batch(spark, tmp_path):
    from graphloom.streaming.progress import distinct_runs, drain

    kinds, rows = "stream_id long, seq long, message string", [(1, 1, "a"), (1, 2, "a"), (2, 1, "x"), (1, 3, "b"), (1, 4, "b"), (2, 2, "y"), (2, 3, "y")]
    stream = lambda: distinct_runs(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drain(stream(), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 1, "a"), (1, 3, "b"), (2, 1, "x"), (2, 2, "y")]


def test_subgraph_falls_back_to_the_method_and_its_class(spark):
    from graphloom.operators import lookup

    src = "class Foo:\n    def run(self, x):\n        return Foo()\n"
    p = P.extract(spark.createDataFrame([("m.py", src)], "path string, content string"))
    n, e = link.build(p)
    without = n.filter("id <> 'python::m.py::Foo::run'")
    rows, _, note = lookup.subgraph(without, e, p, "python::m.py::Foo::run", include_source=True)
    one = rows.collect()
    assert len(one) == 1 and one[0]["label"] == "run" and one[0]["summary"] == "Foo.run | params: self, x | in m.py" and one[0]["line_range"] == "2-3" and "profile" in note
    rows, _, note = lookup.subgraph(without, e, p.filter("kind <> 'method'"), "python::m.py::Foo::run")
    assert {r["id"]: r["is_anchor"] for r in rows.collect()}["python::m.py::Foo"] and "class 'Foo'" in note
    with pytest.raises(ValueError):
        lookup.subgraph(n, e, p, "python::m.py::Gone")
    assert lookup.source_code(p, "python::none").first()["error"] == "not found: python::none"


def test_trace_raises_beyond_its_bound_and_missing_starts_are_named(spark):
    e = edges(spark, [("a", f"n{i}", "CALLS", None) for i in range(20)])
    assert graph.trace(e, "a", 2).count() == 21
    with pytest.raises(ValueError):
        graph.trace(e, "a", 2, most=10)
    named = graph.find_paths(e, ["a", "z"], ["n1"], max_depth=1, nodes=nodes(spark, [("a", "file", "", "a", "a")]))
    assert {(r["start"], r["error"]) for r in named.collect()} == {("a", None), ("z", "Node does not exist.")}
