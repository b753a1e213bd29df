"""Requests, prompts and first-seen lists on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, link, requests
from graphloom.sources import python_source as P


def test_requests_carry_what_is_there(spark):
    card = {"component_id": "c", "module_name": 'M "é"', "directory": "d", "leading_landmarks": [{"id": 1}], "primary_entry_points": [], "core_models": None, "other": 1}
    crumbs = [("k", "T", "function", "python::x", '{"action_parameters":{"paths":[]}}')]
    df = spark.createDataFrame([(json.dumps(card, ensure_ascii=False), crumbs, ["a"])], "card string, crumbs array<struct<node_key:string,title:string,node_type:string,target_id:string,metadata:string>>, objectives array<string>")
    text = df.select(requests.component_request(F.col("card"), F.col("crumbs"), F.col("objectives"))).first()[0]
    payload = json.loads(text.split("\n")[1])
    assert payload == {"component_card": {"component_id": "c", "module_name": 'M "é"', "directory": "d", "business_signal": None, "leading_landmarks": [{"id": 1}], "core_models": []}, "breadcrumbs": [{"node_key": "k", "title": "T", "node_type": "function", "target_id": "python::x", "metadata": {"action_parameters": {"paths": []}}}], "objectives": ["a"]}
    assert 'extract_subgraph(anchor_node_id="python::x", max_depth=1)' in text and 'Path: M "é" > T' in text


def test_prompts_by_pattern(spark):
    one = lambda p: spark.range(1).select(requests.semantic_prompt(F.lit(p).cast("string"), F.lit("C"), F.lit("f"), F.lit(None).cast("string"), F.lit(None).cast("string"))).first()[0]
    assert "REPOSITORY" in one("a") and "VALIDATOR" in one("B") and "SINK" in one("C") and "Context" not in one("C")
    for bad in ("D", "", None):
        with pytest.raises(Exception, match="Unknown pattern"):
            one(bad)
    assert ("rank_nodes", (graph.rank_nodes.__doc__ or "").strip()) in requests.catalogue([graph.rank_nodes, graph.find_paths])


def test_payloads_stand_where_they_are_first_seen(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 2), (1, "b", 1), (1, None, 0), (1, "", 0), (2, None, 1), (None, "z", 1)], "k int, v string, p int")
    assert {r["k"]: r["v"] for r in link.first_seen(df, ["k"], "v", "p").collect()} == {1: ["b", "a"], 2: [], None: ["z"]}
    src = "class Foo: pass\ndef f(x: Foo):\n    zz()\n    Foo()\n    aa()\n    Foo(); zz()\n"
    _, e = link.build(P.extract(spark.createDataFrame([("m.py", src)], "path string, content string")))
    got = {(r["target"].split("::")[-1], r["type"]): [json.loads(p) for p in r["payload"]] for r in e.collect() if r["source"].endswith("::f")}
    assert [p["use_kind"] for p in got["Foo", "USES"]] == ["TYPE_HINT", "INSTANTIATION", "INSTANTIATION"] and [p["line"] for p in got["zz", "CALLS"]] == [3, 6]


def test_dump_lists_what_edges_lead_to(spark):
    n = spark.createDataFrame([("b", "k"), ("a", "k")], "id string, kind string")
    e = spark.createDataFrame([("a", "z", "CALLS"), ("a", "b", "CALLS"), ("b", "z", "USES")], "source string, target string, type string")
    assert [(r["part"], json.loads(r["line"]).get("id") or json.loads(r["line"])["target"]) for r in requests.graph_dump(n, e).collect()] == [("edges", "b"), ("edges", "z"), ("edges", "z"), ("nodes", "a"), ("nodes", "b"), ("unresolved", "z")]


def test_messages_lose_what_is_not_theirs(spark):
    from graphloom.operators import workflows

    rows = [(1, 0, "system", "s", "x", "y"), (1, 1, "human", '["a", {"text": "b"}, {"image": 1}, ""]', "x", "y"), (1, 2, "ai", "[not json", '[{"n":1}]', "y"), (1, 3, "tool", None, "x", "id"), (2, 0, "ai", "only", "", "y")]
    m = spark.createDataFrame(rows, "c int, t int, type string, content string, tool_calls string, tool_call_id string").withColumn("name", F.lit("tool-x"))
    got = [tuple(r)[1:] for r in workflows.message_rows(m, "c", "t").orderBy("c", "index").collect()]
    assert got == [(1, "SystemMessage", "s", None, None), (2, "HumanMessage", "a\nb", None, None), (3, "AIMessage", "[not json", '[{"n":1}]', None), (4, "ToolMessage", "", None, "id"), (1, "AIMessage", "only", None, None)]
    stacks = {(r["c"], r["place"]): (r["type"], r["content"]) for r in workflows.reduced_messages(m, "c", "t", F.lit("p")).collect()}
    assert set(stacks) == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 3)} and stacks[1, 1] == ("system", "p") and stacks[2, 3][1].endswith("[]")
