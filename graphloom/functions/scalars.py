"""Column functions: names, paths, ids, texts, numbers, JSON. All are built-in expressions but the scan for balanced braces, which goes over batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TTL_DAYS = 7
DRILLABLE = ("class", "workflow", "service", "category", "capability")


def compact(x: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(x, r"\s+", "")


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def one_of(words: list[str]) -> str:
    """A regular expression for any of some words: one literal in a plan, however many there are."""
    return "(" + "|".join(re.escape(w) for w in words) + ")"


def contains_any(parts: Column, words: list[str]) -> Column:
    """Whether a part contains one of the words as a substring."""
    return F.exists(parts, lambda p: p.rlike(one_of(words)))


def ends_with_any(parts: Column, words: list[str]) -> Column:
    return F.exists(parts, lambda p: p.rlike(one_of(words) + "$"))


def last_token(call: Column) -> Column:
    """After the last dot, then after the last `::`."""
    return F.element_at(F.split(F.element_at(F.split(call, r"\."), -1), "::"), -1)


def is_dunder(name: Column) -> Column:
    return name.startswith("__") & name.endswith("__")


def module_file(module: Column) -> Column:
    return F.concat(F.translate(module, ".", "/"), F.lit(".py"))


def file_module(path: Column) -> Column:
    return F.translate(F.regexp_replace(slashes(path), r"\.py$", ""), "/", ".")


def title_case(name: Column) -> Column:
    """Of kebab case; the tail of each word becomes lower case."""
    return F.array_join(F.transform(F.split(name, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " ")


def shorten(text: Column, most: int, mark: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def category(cat: Column, kind: Column) -> Column:
    return F.coalesce(F.nullif(cat, F.lit("")), F.nullif(kind, F.lit("")), F.lit("unknown"))


def parse_id(node: Column) -> Column:
    """`python::path[::Class...][::func]`, with the file marker `python::file::path`: path, class_name, function_name."""
    parts = F.split(node, "::")
    marked = F.get(parts, F.lit(1)) == "file"
    last, n = F.element_at(parts, -1), F.size(parts)
    upper = F.substring(last, 1, 1).rlike("[A-Z]")
    return F.struct(
        F.when(marked, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"),
        F.when(marked | (n < 3), F.lit(None)).when(upper, F.array_join(F.slice(parts, 3, F.greatest(n - 2, F.lit(0))), ".")).otherwise(F.nullif(F.array_join(F.slice(parts, 3, F.greatest(n - 3, F.lit(0))), "."), F.lit(""))).alias("class_name"),
        F.when(marked | (n < 3) | upper, F.lit(None)).otherwise(last).alias("function_name"),
    )


def node_id(path: Column, symbol: Column) -> Column:
    """Null when just one part is given; a constraint column may report that."""
    return F.when(path.isNotNull() & symbol.isNotNull(), F.concat_ws("::", F.lit("python"), path, symbol))


def breadcrumb_key(keys: Column) -> Column:
    return F.when(F.size(keys) == 0, F.lit("root")).otherwise(F.substring(F.md5(F.array_join(keys, "→")), 1, 12))


def size_text(n: Column) -> Column:
    return F.when(n < 1024 * 1024, F.concat(F.format_string("%.1f", F.bround(n / 1024.0, 1)), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", F.bround(n / 1048576.0, 1)), F.lit(" MB")))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def token_cost(prompt: Column, completion: Column) -> Column:
    return F.round((prompt * 0.075 + completion * 0.30) / 1e6, 6)


def expired(updated: Column, now: Column, days: int = TTL_DAYS) -> Column:
    return updated < now - F.expr(f"INTERVAL {days} DAYS")


def enum_or_null(x: Column, domain: list[str]) -> Column:
    got = F.translate(F.lower(F.trim(x)), " ", "_")
    return F.when(got.isin(domain), got)


def comma_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), lambda v: F.trim(v)), lambda v: v != "")


def glob_regex(pattern: str) -> str:
    """A glob as a regex for rlike: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + pattern[i] if pattern[i] in ".^$+{}[]()|\\" else pattern[i]), i + 1
    return f"^(?:.*/)?{out}$"


def json_in_text(text: Column) -> Column:
    """The JSON object of a reply: as it is, in a fence, or from the first to the last brace; null if none parses."""
    tries = [text, F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)]
    return F.coalesce(*[F.when(F.try_parse_json(F.trim(t)).isNotNull() & F.trim(t).startswith("{"), F.trim(t)) for t in tries])


_BRACES = re.compile(r"\\.|\"(?:\\.|[^\"\\])*\"|[{}\"]", re.S)


def first_balanced(text: str | None) -> str | None:
    """From the first brace to the one that closes it. Braces in strings don't count, nor what a backslash escapes; null if it isn't closed."""
    start = -1 if text is None else text.find("{")
    depth = 0
    for m in _BRACES.finditer(text, start) if start >= 0 else ():
        if m[0] == '"':  # a string without an end
            return None
        depth += (m[0] == "{") - (m[0] == "}")
        if depth == 0 and m[0] == "}":
            return text[start : m.end()]
    return None


def balanced_object(text: Column) -> Column:
    """first_balanced() over batches of texts."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_balanced)

    return run(text)


def action_valid(node_type: Column, action: Column) -> Column:
    """Drillable types go with component_drilldown, all others with inspect_source."""
    return action == F.when(node_type.isin(*DRILLABLE), "component_drilldown").otherwise("inspect_source")


# ---- Fixed values: references to repositories: page, page of a branch, ssh, shorthand; owner, repository and branch in order.
GITHUB = [
    r"^https?://github\.com/([^/]+)/([^/]+?)(?:\.git)?/?$",
    r"^https?://github\.com/([^/]+)/([^/]+)/tree/([^/]+)",
    r"^git@github\.com:([^/]+)/([^/]+?)(?:\.git)?$",
    r"^([^/]+)/([^/]+)$",
]


def github_parts(url: Column) -> Column:
    """owner, repo, branch of a reference to a repository; all null if it is none. The first form that fits holds."""
    u = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    part = lambda i, form: F.regexp_extract(u, form, i)
    found = F.lit(None).cast("struct<owner:string,repo:string,branch:string>")
    for form in reversed(GITHUB):
        branch = part(3, form) if "/tree/" in form else F.lit(None).cast("string")
        found = F.when(u.rlike(form), F.struct(part(1, form).alias("owner"), F.regexp_replace(part(2, form), r"\.git$", "").alias("repo"), branch.alias("branch"))).otherwise(found)
    return F.struct(*(found[c].alias(c) for c in ("owner", "repo", "branch")))


def repaired_id(node: Column) -> Column:
    """`python::` ids as models write them, mended: a type marker before a dotted path, or dots for slashes in the file part."""
    rest = F.substring(node, 9, 1 << 20)
    dotted = F.split(F.regexp_extract(rest, r"^(?:class|method|function)::(.*)$", 1), r"\.")
    # the last piece that starts with a capital begins the class
    at = F.aggregate(F.transform(dotted, lambda x, i: F.when(x.rlike(r"^\p{Lu}"), i).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x))
    marked = F.when(rest.rlike(r"^(class|method|function)::") & (at > 0), F.concat(F.lit("python::"), F.array_join(F.slice(dotted, F.lit(1), at), "/"), F.lit(".py::"), F.array_join(F.slice(dotted, at + 1, F.size(dotted)), ".")))
    parts = F.split(rest, "::")
    file = F.get(parts, F.lit(0))
    slashed = F.when((F.size(parts) >= 2) & file.contains(".") & ~file.contains("/") & ~file.endswith(".py"), F.concat(F.lit("python::"), F.translate(file, ".", "/"), F.lit(".py::"), F.get(parts, F.lit(1))))
    return F.when(node.startswith("python::"), F.coalesce(marked, slashed, node)).otherwise(node)


def id_problem(path: Column, symbol: Column) -> Column:
    """Why node_id() gives none: exactly one part is there."""
    return F.when(path.isNull() & symbol.isNotNull(), "path is missing").when(path.isNotNull() & symbol.isNull(), "symbol is missing")


def shown_log(log: Column) -> Column:
    """What a user sees of an agent's log line; null if nothing."""
    tool = lambda kind, text: F.when(log.rlike(rf"^\[tool:{kind}\] \w+"), F.format_string(text, F.regexp_extract(log, rf"^\[tool:{kind}\] (\w+)", 1)))
    return (
        F.when(log.startswith("[tool:start]"), tool("start", "Calling %s...")).when(log.startswith("[tool:end]"), tool("end", "Got results from %s")).when(log.startswith("[llm:output]"), "Analyzing results...")
        .when(log.startswith("[orchestration]"), F.when(log.contains("Starting"), "Starting analysis...").when(log.contains("completed"), "Finalizing components..."))
        .when(log.startswith("[structured_output]"), F.when(log.contains("success"), "Finalizing navigation nodes...").otherwise("Generating structured response..."))
        .when(log.startswith("[llm:input]"), "Processing context...")
    )


def findings_text(classes: Column, public: Column, private: Column, dependencies: Column, inheritance: Column, implements: Column, attributes: Column) -> Column:
    """A line per kind that has some; five dependencies and attributes at most."""
    line = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{name}: "), F.array_join(xs, ", ")))
    return F.concat_ws(
        "\n", line("Classes", classes), line("Public methods", public), line("Private methods", private), line("Dependencies", F.slice(dependencies, 1, 5)),
        F.when(F.coalesce(inheritance, F.lit("")) != "", F.concat(F.lit("Inheritance: "), inheritance)), line("Implements", implements), line("Key attributes", F.slice(attributes, 1, 5)),
    )


def first_given(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def last_symbol(node: Column) -> Column:
    return F.element_at(F.split(node, "::"), -1)


def prompt_name(phase: Column, focus: Column, pattern: Column) -> Column:
    """Which system prompt a phase takes."""
    drill = F.when(focus.isin("class", "function", "method", "module"), "class_drill").when(pattern.isin("A", "B", "C"), F.concat(F.lit("drill_"), F.lower(pattern))).otherwise("drill_generic")
    return F.when(phase == "drill", drill).when(focus == "class", "class_inspector").otherwise("scout")


def short_or_inferred(docstring: Column, kind: Column, class_name: Column, function_name: Column, parameters: Column, path: Column, start: Column) -> Column:
    """A docstring of 300 characters at most, or what names, parameters and path say."""
    doc = F.trim(docstring)
    name = F.when(class_name.isNotNull() & function_name.isNotNull(), F.concat_ws(".", class_name, function_name)).otherwise(F.coalesce(function_name, F.concat(F.lit("class "), class_name)))
    some = F.filter(F.split(slashes(path), "/"), lambda x: (x != "") & ~x.startswith("."))
    where = F.when(F.size(some) > 0, F.concat(F.lit("in "), F.array_join(F.slice(some, F.greatest(F.size(some) - 2, F.lit(1)), F.lit(3)), "/")))
    inferred = F.concat_ws(" | ", name, F.when(F.size(parameters) > 0, F.concat(F.lit("params: "), F.array_join(F.slice(parameters, 1, 5), ", "))), where)
    return F.when(F.coalesce(doc, F.lit("")) != "", shorten(doc, 300, "...")).when(inferred != "", inferred).otherwise(F.concat(kind, F.lit(" at line "), start))
