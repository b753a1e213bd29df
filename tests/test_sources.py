"""The file source, files that don't parse, balanced braces, patterns that only Python knows, contexts."""

import json
import random

from pyarrow import fs
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import text, workflows
from graphloom.sources import files
from graphloom.sources import python_source as P


class Watched:
    """A file system that remembers which folders were listed."""

    def __init__(self):
        self.store, self.opened = fs.LocalFileSystem(), []

    def get_file_info(self, selector):
        self.opened.append(selector.base_dir)
        return self.store.get_file_info(selector)


def tree(tmp_path):
    for path in ("a/x.py", "a/y.md", "a/.hidden.py", "a/.py", "node_modules/p/z.py", "a/build/deep/w.py", "b/node_modules_2/v.py", "b/noext", "top.py", "b/c.tar.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("def f():\n    g()\n")
    return str(tmp_path)


def test_ignored_folders_are_never_opened(spark, tmp_path):
    root, watched = tree(tmp_path), Watched()
    got = dict(files.find_files(watched, root, {".py"}, set(files.IGNORED)))
    kept = {"a/x.py", "a/.hidden.py", "b/node_modules_2/v.py", "top.py", "b/c.tar.py"}
    assert set(got) == kept and {p[len(root) :].lstrip("/") for p in watched.opened} == {"", "a", "b", "b/node_modules_2"}
    assert {r["path"] for r in files.read_files(spark, root).collect()} == kept
    assert {r["path"] for r in files.read_files(spark, root, ignored=["b"]).collect()} == {"a/x.py", "a/.hidden.py", "node_modules/p/z.py", "a/build/deep/w.py", "top.py"}


def test_handlers_by_suffix(spark, tmp_path):
    root = tree(tmp_path)
    got = {r["id"]: r for r in files.read_profiles(spark, root, handlers={".py": P.profiles_of, ".md": files.text_profile}).collect()}
    assert got["python::a/x.py::f"]["calls"] == ["g"] and got["text::file::a/y.md"]["end_line"] == 3 and len(got) == 11
    assert got["python::a/x.py::f"]["call_sites"][0]["expression"] == "g" and files.read_profiles(spark, root, handlers={".no": files.text_profile}).count() == 0


BAD = '''import x
class A(B):
    """calls no(1)"""
    x = skip(1)
    def go(self, y=default(
            3)):
        self.load(a.b(c . d ()))  # not(1)
        print("so(1)", 'it\\'s(2)')
        if (y): while_(1)
        def inner(): hidden(1)
    class C:
        async def deep(self): await one(2)

def top(:
    return A(1)
'''


def test_files_that_do_not_parse_still_yield_calls():
    got = {r["id"].removeprefix("python::"): r for r in P.profiles_of("m.py", BAD.encode())}
    assert set(got) == {"file::m.py", "m.py::A", "m.py::A::go", "m.py::A::C", "m.py::A::C::deep", "m.py::top"} and got["file::m.py"]["error"].startswith("SyntaxError")
    assert got["m.py::A::go"]["calls"][-5:] == ["self.load", "a.b", "c.d", "print", "while_"] or {"self.load", "a.b", "c.d", "print", "while_"} <= set(got["m.py::A::go"]["calls"])
    assert got["m.py::A::C::deep"]["calls"] == ["one"] and got["m.py::top"]["calls"] == ["A"] and got["m.py::A::go"]["kind"] == "method" and got["m.py::A"]["children"] == ["python::m.py::A::go", "python::m.py::A::C"]
    assert not {"no", "not", "so", "it", "if"} & set(got["m.py::A::go"]["calls"])


def plain_balanced(t):
    at = t.find("{")
    if at < 0:
        return None
    depth = quoted = skip = 0
    for i in range(at, len(t)):
        c = t[i]
        if skip:
            skip = 0
        elif c == "\\":
            skip = 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return t[at : i + 1]
    return None


def test_balanced_braces(spark):
    r = random.Random(1)
    texts = ["".join(r.choice('{}"\\ab{ }') for _ in range(r.randint(0, 14))) for _ in range(4000)] + ['x {"a": "}", "b": {"c": "\\"{"}} {"d": 1}', "{", '{"a": "x', None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.balanced_object(F.col("t")).alias("o")).collect()
    assert all(x["o"] == (None if x["t"] is None else plain_balanced(x["t"])) for x in rows) and sum(x["o"] is not None for x in rows) > 300


def test_patterns_that_only_python_knows(spark):
    f = spark.createDataFrame([("a.py", "xx yy\r\nab\n\n"), ("b.py", "aa\tb  \nß")], "path string, content string")
    lines = lambda q: [(r["path"], r["line"]) for r in text.search(f, q, 1).collect()]
    assert lines(r"(?P<a>\w)(?P=a)") == [("a.py", 1), ("b.py", 1)]
    assert text.java_regex(spark, r"(x)?(?(1)x|a)") is None and lines(r"^(x)?(?(1)x|a)") == [("a.py", 1), ("a.py", 2), ("b.py", 1)]
    assert lines("^$") == [("a.py", 3)] and lines(r"^\w$") == [("b.py", 2)] and lines("(") == []
    assert text.search(f, "aa", 1).first()["context"] == "   1 >>> aa\tb\n   2     ß"


def test_contexts_hold_steps_as_json(spark):
    p = spark.createDataFrame([("a", "f.py", "run", None, "src", None), ("b", "f.py", None, "B", "s", json.dumps({"summary": {"level_1": {"text": "é"}}, "workflow_hints": {"x": [1]}})), ("c", "f.py", None, None, "s", json.dumps({"summaries": {"k": 1}, "name": "named"}))], "id string, file_path string, function_name string, class_name string, source_code string, data string")
    trace = spark.createDataFrame([(0, "a"), (1, "gone"), (2, "b"), (3, "a"), (4, "c")], "position long, id string")
    got = workflows.llm_context(trace, p).collect()
    step = lambda s, h: json.dumps({"summary": s, "workflow_hints": h}, indent=2)
    assert len(got) == 1 and got[0]["entry"] == "a"
    assert got[0]["context"] == f"### WORKFLOW ENTRY POINT: SOURCE CODE\nFile: f.py\nName: run\n```python\nsrc\n```\n\n### KEY STEPS IN THE CALL CHAIN: SUMMARIES\n--- Step 1: B ---\n{step('é', {'x': [1]})}\n--- Step 2: named ---\n{step({'k': 1}, None)}"
