"""Python source files to profiles, entry points and models. One task reads a file; everything after that is joins."""

from __future__ import annotations

import ast
import keyword
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROFILE = "id string, kind string, file_path string, function_name string, class_name string, start_line int, end_line int, source_code string, parent_id string, docstring string, parameters array<string>, calls array<string>, call_sites array<struct<expression:string,line:int>>, import_sites array<struct<module:string,name:string,alias:string,line:int,level:int>>, inheritance array<struct<symbol:string,line:int>>, uses array<struct<symbol:string,use_kind:string,line:int,detail:string>>, children array<string>, error string"
VERBS = {"get", "post", "put", "patch", "delete", "head", "options", "trace"}
ROUTES = VERBS | {"route", "api_route", "websocket"}
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def name_of(node: ast.AST | None) -> str | None:
    """A name, or a dotted attribute that is rooted in a name; subscripts and calls are unwrapped; other expressions as text without white space."""
    while isinstance(node, (ast.Subscript, ast.Call)):
        node = node.value if isinstance(node, ast.Subscript) else node.func
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = node.value
        while isinstance(left, ast.Attribute):
            left = left.value
        return ast.unparse(node) if isinstance(left, ast.Name) else None
    return "".join(ast.unparse(node).split()) if node is not None else None


def _calls(node: ast.AST) -> list[dict]:
    """Calls of one function; bodies of functions and classes inside it are left out, their decorators and defaults are not."""
    found: dict[tuple[str, int], None] = {}

    def walk(x: ast.AST, top: bool) -> None:
        if isinstance(x, _DEFS) and not top:
            for y in [*x.decorator_list, *(x.args.defaults if not isinstance(x, ast.ClassDef) else x.bases)]:
                walk(y, False)
            return
        if isinstance(x, ast.Call) and (n := name_of(x.func)):
            found[n, x.lineno] = None
        for y in ast.iter_child_nodes(x):
            walk(y, False)

    walk(node, True)
    return [{"expression": e, "line": n} for e, n in found]


def _uses(node) -> list[dict]:
    out = [{"symbol": s, "use_kind": "DECORATOR", "line": d.lineno, "detail": None} for d in node.decorator_list if (s := name_of(d))]
    if isinstance(node, ast.ClassDef):
        return out
    a = node.args
    every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]
    for hint, detail in [(x.annotation, f"parameter:{x.arg}") for x in every if x.annotation and x.arg not in ("self", "cls")] + ([(node.returns, "return")] if node.returns else []):
        for x in ast.walk(hint):
            if isinstance(x, (ast.Name, ast.Attribute)) and (s := name_of(x)):
                out.append({"symbol": s, "use_kind": "TYPE_HINT", "line": x.lineno, "detail": detail})
    return out


def _imports(tree: ast.Module, path: str) -> list[dict]:
    package = path.removesuffix(".py").split("/")
    out: dict[tuple, dict] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            rows = [(a.name, None, a.asname, 0) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            module = ".".join([*package[: len(package) - n.level], *([n.module] if n.module else [])]) if n.level else n.module
            rows = [(module, a.name, a.asname, n.level) for a in n.names if a.name != "*"]
        else:
            continue
        for m, name, alias, level in rows:
            out[m, name, alias, n.lineno] = {"module": m, "name": name, "alias": alias, "line": n.lineno, "level": level}
    return list(out.values())


def profiles_of(path: str, content: bytes) -> list[dict]:
    """Profiles of one file. What can't be decoded gives one file row with the error; what can't be parsed, a file row with the error and what outline_of() finds."""
    blank = dict.fromkeys([c.split()[0] for c in PROFILE.split(", ")])
    me = blank | {"id": f"python::file::{path}", "kind": "file", "file_path": path, "start_line": 1, "children": []}
    try:
        text = bytes(content).decode("utf-8")
        me |= {"source_code": text, "end_line": text.count("\n") + 1}
        tree = ast.parse(text)
    except UnicodeDecodeError as e:
        return [me | {"error": f"{type(e).__name__}: {e}"}]
    except (SyntaxError, ValueError) as e:
        return outline_of(path, text, me | {"error": f"{type(e).__name__}: {e}"}, blank)
    lines, out = text.split("\n"), {}
    me |= {"import_sites": _imports(tree, path), "docstring": ast.get_docstring(tree)}
    out[me["id"]] = me

    def visit(body: list, parent: dict, classes: list[str]) -> None:
        for n in body:
            if not isinstance(n, _DEFS):
                continue
            is_class = isinstance(n, ast.ClassDef)
            key = "::".join(["python", path, *classes, n.name])
            start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
            row = blank | {"id": key, "kind": "class" if is_class else "method" if classes else "function", "file_path": path, "function_name": None if is_class else n.name, "class_name": ".".join([*classes, n.name] if is_class else classes) or None, "start_line": start, "end_line": n.end_lineno, "source_code": "\n".join(lines[start - 1 : n.end_lineno]), "parent_id": parent["id"], "docstring": ast.get_docstring(n), "uses": _uses(n), "children": []}
            if is_class:
                row["inheritance"] = [{"symbol": s, "line": b.lineno} for b in n.bases if (s := name_of(b))]
            else:
                a = n.args
                row["parameters"] = [x.arg for x in [*a.posonlyargs, *a.args]] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
                row["call_sites"] = _calls(n)
                row["calls"] = list(dict.fromkeys(c["expression"] for c in row["call_sites"]))
            parent["children"].append(key)
            out[key] = row
            if is_class:
                visit(n.body, row, [*classes, n.name])

    visit(tree.body, me, [])
    return list(out.values())


_HEAD = re.compile(r"([ \t]*)(?:async[ \t]+def|def|class)[ \t]+(\w+)")
_QUIET = re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|\"(?:\\.|[^\"\\\n])*\"?|\'(?:\\.|[^\'\\\n])*\'?|\#[^\n]*", re.S)
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)\s*\(")


def outline_of(path: str, text: str, me: dict, blank: dict) -> list[dict]:
    """Profiles of a file that doesn't parse: classes and functions by their first lines and indentation, with the names that are called in them. Strings and comments are blanked
    first; a function ends before the next line that is indented no deeper; what functions hold is theirs."""
    bare = _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    lines, quiet = text.split("\n"), bare.split("\n")
    depth = [len(q.expandtabs()) - len(q.expandtabs().lstrip()) if q.strip() else None for q in quiet]
    out, open_ = [me], [(-1, True, [], me)]
    for i, q in enumerate(quiet):
        if depth[i] is None:
            continue
        while open_[-1][0] >= depth[i]:
            open_.pop()
        head = _HEAD.match(q)
        if not head or not open_[-1][1]:
            continue
        _, _, classes, parent = open_[-1]
        is_class, name = "class" in head[0].split(), head[2]
        end = next((j for j in range(i + 1, len(quiet)) if depth[j] is not None and depth[j] <= depth[i] and not quiet[j].lstrip().startswith((")", "]"))), len(quiet))
        while end > i + 1 and depth[end - 1] is None:
            end -= 1
        key = "::".join(["python", path, *classes, name])
        row = blank | {"id": key, "kind": "class" if is_class else "method" if classes else "function", "file_path": path, "function_name": None if is_class else name, "class_name": ".".join([*classes, name] if is_class else classes) or None, "start_line": i + 1, "end_line": end, "source_code": "\n".join(lines[i:end]), "parent_id": parent["id"], "children": []}
        if not is_class:
            body = "\n".join([q[head.end() :].partition(")")[2], *quiet[i + 1 : end]])
            row["calls"] = list(dict.fromkeys(c for m in _CALL.finditer(body) if not keyword.iskeyword(c := "".join(m[1].split())) and not _HEAD.search(body, body.rfind("\n", 0, m.start()) + 1, m.end())))
        parent["children"].append(key)
        out.append(row)
        open_.append((depth[i], is_class, [*classes, name], row))
    return out


def extract(files: DataFrame) -> DataFrame:
    """profiles of files(path, content)."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"], strict=True) for r in profiles_of(p, c.encode() if isinstance(c, str) else c)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROFILE.split(", ")])

    return files.select("path", "content").mapInPandas(run, PROFILE)


ENTRY = "route string, http_methods array<string>, function_name string, class_name string, file_path string, line int, framework string, docstring string"


def _routes(path: str, text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    imported = {x for n in ast.walk(tree) for x in ([a.name.split(".")[0] for a in n.names] if isinstance(n, ast.Import) else [(n.module or "").split(".")[0]] if isinstance(n, ast.ImportFrom) else [])}
    out = []

    def visit(body, cls):
        for n in body:
            if isinstance(n, ast.ClassDef):
                visit(n.body, f"{cls}.{n.name}" if cls else n.name)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                for d in n.decorator_list:
                    if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTES):
                        continue
                    verb, kw = d.func.attr, {k.arg: k.value for k in d.keywords}
                    at = d.args[0] if d.args else next((kw[k] for k in ("path", "rule", "route") if k in kw), None)
                    route = at.value if isinstance(at, ast.Constant) and isinstance(at.value, str) else ast.unparse(at) if at is not None else None
                    listed = kw.get("methods") or kw.get("method")
                    items = listed.elts if isinstance(listed, (ast.List, ast.Tuple, ast.Set)) else [listed] if listed is not None else []
                    methods = [x.value.upper() for x in items if isinstance(x, ast.Constant) and isinstance(x.value, str)]
                    owner = (name_of(d.func.value) or "").lower()
                    framework = "fastapi" if "fastapi" in imported else "flask" if "flask" in imported else "fastapi" if "router" in owner else "flask" if "blueprint" in owner or owner.endswith("bp") or owner == "app" else "unknown"
                    out.append({"route": route, "http_methods": methods or (["WEBSOCKET"] if verb == "websocket" else [verb.upper()] if verb in VERBS else ["GET"]), "function_name": n.name, "class_name": cls, "file_path": path, "line": n.lineno, "framework": framework, "docstring": ast.get_docstring(n)})

    visit(tree.body, None)
    return out


def entry_points(files: DataFrame, profiles: DataFrame | None = None, framework: str | None = None, path_contains: str | None = None, limit: int = 20) -> DataFrame:
    """Routed functions by (route, file, line); with profiles, also the id of the function's profile."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([r for p, c in zip(b["path"], b["content"], strict=True) for r in _routes(p, c if isinstance(c, str) else c.decode("utf-8", "replace"))], columns=[c.split()[0] for c in ENTRY.split(", ")])

    found = files.filter(F.col("content").cast("string").contains("@")).select("path", "content").mapInPandas(run, ENTRY)
    if framework:
        found = found.filter(F.lower("framework") == framework.lower())
    if path_contains:
        found = found.filter(F.lower("file_path").contains(path_contains.lower()))
    found = found.withColumn("label", F.concat_ws(".", "class_name", "function_name"))
    if profiles is not None:
        p = profiles.filter("function_name is not null").select(F.col("file_path").alias("_f"), F.col("class_name").alias("_c"), F.col("function_name").alias("_n"), F.col("id").alias("profile_id"))
        found = found.join(p, (F.col("file_path") == F.col("_f")) & F.col("class_name").eqNullSafe(F.col("_c")) & (F.col("function_name") == F.col("_n")), "left").drop("_f", "_c", "_n")
    return found.orderBy("route", "file_path", "line").limit(limit)


MODEL = "id string, model_name string, file_path string, start_line int, bases array<string>, fields array<struct<name:string,field_type:string,args:array<string>,line:int>>, meta map<string,string>, error string"


def _model(row) -> dict:
    out = {"id": row.id, "model_name": row.class_name, "file_path": row.file_path, "start_line": row.start_line, "bases": [], "fields": [], "meta": {}, "error": None}
    try:
        import textwrap

        node = ast.parse(textwrap.dedent(row.source_code)).body[0]
    except (SyntaxError, IndexError, ValueError) as e:
        return out | {"error": type(e).__name__}
    out["bases"] = [s for b in node.bases if (s := name_of(b))]
    for n in node.body:
        value, targets = (n.value, n.targets) if isinstance(n, ast.Assign) else (n.value, [n.target]) if isinstance(n, ast.AnnAssign) else (None, [])
        if isinstance(value, ast.Call) and (kind := name_of(value.func)) and kind.split(".")[-1].endswith("Field"):
            out["fields"] += [{"name": ast.unparse(t), "field_type": kind.split(".")[-1], "args": [ast.unparse(a) for a in value.args] + [f"{k.arg}={ast.unparse(k.value)}" for k in value.keywords], "line": row.start_line + n.lineno - 1} for t in targets]
        if isinstance(n, ast.ClassDef) and n.name == "Meta":
            out["meta"] = {ast.unparse(t): ast.unparse(x.value) for x in n.body if isinstance(x, ast.Assign) for t in x.targets}
    return out


def core_models(profiles: DataFrame, folders: tuple[str, ...] = ("api", "db"), limit: int = 50) -> DataFrame:
    """Classes in the folders, with fields (assignments of calls that end in Field) and Meta; classes without fields too."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    path = F.concat(F.lit("/"), F.regexp_replace(F.translate("file_path", "\\", "/"), "^/+|/+$", ""), F.lit("/"))
    inside = F.lit(False)
    for d in folders:
        inside = inside | path.contains(f"/{d.strip('/')}/")
    got = profiles.filter((F.col("kind") == "class") & inside).orderBy("id").limit(limit).select("id", "class_name", "file_path", "start_line", "source_code")

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([_model(r) for r in b.itertuples()], columns=[c.split()[0] for c in MODEL.split(", ")])

    return got.mapInPandas(run, MODEL)
