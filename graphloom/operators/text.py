"""Operators over files(path, content): globbing and line search with context."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import glob_regex, size_text

# ---- Fixed values: folders that are never scanned.
IGNORED = [".git", "__pycache__", "node_modules", "venv", ".venv", ".idea", "dist", "build", ".egg-info", ".tox", ".pytest_cache", ".mypy_cache", ".ruff_cache"]
# ---- Fixed values: suffixes of text files.
TEXT_SUFFIXES = [".py", ".md", ".yaml", ".yml", ".json", ".txt", ".sh", ".ini", ".toml", ".js", ".ts", ".tsx", ".jsx", ".css", ".html", ".xml", ".cfg", ".conf", ".env", ".dockerfile"]
# ---- Fixed values: names of text files.
TEXT_NAMES = ["Dockerfile", "Makefile", "README", "LICENSE", "CHANGELOG", ".gitignore", ".dockerignore", ".env"]


def visible(files: DataFrame) -> DataFrame:
    return files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in IGNORED])))


def is_text(path):
    return F.regexp_extract(path, r"([^/]+)$", 1).isin(*TEXT_NAMES) | F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)).isin(*TEXT_SUFFIXES)


def scan(files: DataFrame, patterns: list[str], limit: int = 50) -> DataFrame:
    """path, pattern (the first that fits), size. In path order up to the limit."""
    if not patterns or not 1 <= limit <= 200:
        raise ValueError("at least one pattern, and a limit of 1 to 200")
    first = F.lit(None).cast("string")
    for p in reversed(patterns):
        first = F.when(F.col("path").rlike(glob_regex(p)), F.lit(p)).otherwise(first)
    got = visible(files).withColumn("pattern", first).filter("pattern is not null")
    return got.select("path", "pattern", size_text(F.octet_length("content")).alias("size")).orderBy("path").limit(limit)


def java_regex(spark: SparkSession, query: str) -> str | None:
    """The query as a Java pattern with the same classes, a literal if it is no valid pattern; None if only Python knows it."""
    try:
        re.compile(query)
    except re.error:
        query = re.escape(query)
    found = "(?U)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<(\w+)>", r"(?<\1>", query)).replace("\\Z", "\\z")
    return found if _compiles(spark, found) else None


def _compiles(spark: SparkSession, pattern: str) -> bool:
    from pyspark.errors import IllegalArgumentException

    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except IllegalArgumentException:
        return False


def _matching(spark: SparkSession, query: str, text: Column) -> Column:
    """Whether a line matches: by the JVM, or by Python over batches of lines where only Python knows the pattern."""
    rx = java_regex(spark, query)
    if rx is not None:
        return text.rlike(rx)

    @F.pandas_udf("boolean")
    def found(lines: pd.Series) -> pd.Series:
        pattern = re.compile(query)
        return lines.map(lambda x: pattern.search(x) is not None)

    return found(text)


def lines_of(content: Column) -> Column:
    """The lines of a text; what follows the last line end is a line only if it isn't empty."""
    lines = F.split(content, r"\r\n?|\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def search(files: DataFrame, query: str, context: int = 2, pattern: str | None = None, limit: int | None = 30) -> DataFrame:
    """path, line, text, context: lines that match, with `context` lines on either side (number, mark, text without white space at its end), in order of path and line up to the limit."""
    if not 0 <= context <= 5:
        raise ValueError("context is 0 to 5")
    found = visible(files).filter(is_text(F.col("path")))
    if pattern:
        found = found.filter(F.col("path").rlike(glob_regex(pattern)))
    lines = found.select("path", lines_of(F.col("content")).alias("all")).select("path", "all", F.posexplode("all").alias("i", "text"))
    lines = lines.filter(_matching(files.sparkSession, query, F.col("text")))
    lo = F.greatest(F.col("i") - context, F.lit(0))
    around = F.transform(F.slice("all", lo + 1, F.least(F.col("i") + context, F.size("all") - 1) - lo + 1), lambda t, k: F.concat(F.lpad((lo + k + 1).cast("string"), F.greatest(F.lit(4), F.length((lo + k + 1).cast("string"))), F.lit(" ")), F.when(lo + k == F.col("i"), " >>> ").otherwise("     "), F.regexp_replace(t, r"(?U)\s+$", "")))
    out = lines.select("path", (F.col("i") + 1).alias("line"), "text", F.array_join(around, "\n").alias("context"))
    return out if limit is None else out.orderBy("path", "line").limit(limit)


def numbered(files: DataFrame, first: int = 1) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text")).select("path", (F.col("i") + first).alias("line"), "text")


def last_of_each(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("r") <= n)
