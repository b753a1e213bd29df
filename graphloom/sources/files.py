"""Source files as a Spark data source: ignored folders are never listed, and a handler by suffix turns each file into profiles.

While it plans, the source walks the folders level by level, leaves out ignored ones by their exact names, keeps the files that a handler is registered for, and deals them into partitions by
size; each partition reads its own files. Paths are those of any file system that pyarrow knows.

    register(spark)
    spark.read.format("source_files").option("root", "/src").load()                       # path, content
    spark.read.format("source_files").option("root", "/src").option("as", "profiles").load()
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.sources.python_source import PROFILE, profiles_of

#: Folders that are ignored unless others are named.
IGNORED = [".git", "__pycache__", "node_modules", ".venv", "venv", "build", "dist"]
#: Bytes and files of a partition.
PART_BYTES, PART_FILES = 32 << 20, 2000

#: From a file's path and bytes to its profiles.
Handler = Callable[[str, bytes], list[dict]]
HANDLERS: dict[str, Handler] = {".py": profiles_of}


def text_profile(path: str, content: bytes) -> list[dict]:
    """A handler for files without structure: one profile with the text."""
    text = content.decode("utf-8", "replace")
    blank = dict.fromkeys([c.split()[0] for c in PROFILE.split(", ")])
    return [blank | {"id": f"text::file::{path}", "kind": "file", "file_path": path, "source_code": text, "start_line": 1, "end_line": text.count("\n") + 1, "children": []}]


def suffix_of(name: str) -> str:
    """The last suffix of a name; a name that begins with its only dot has none."""
    at = name.rfind(".")
    return name[at:] if 0 < at < len(name) - 1 else ""


def find_files(store, root: str, suffixes: set[str], ignored: set[str]) -> Iterator[tuple[str, int]]:
    """(path below root, size) of the files with the suffixes; ignored folders aren't opened."""
    from pyarrow import fs

    waiting = [root]
    while waiting:
        here = waiting.pop()
        for x in sorted(store.get_file_info(fs.FileSelector(here, recursive=False)), key=lambda x: x.base_name):
            if x.type == fs.FileType.Directory:
                if x.base_name not in ignored:
                    waiting.append(x.path)
            elif x.type == fs.FileType.File and suffix_of(x.base_name) in suffixes:
                yield x.path[len(root) :].lstrip("/"), x.size


@dataclass
class Part(InputPartition):
    paths: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, handlers: dict[str, Handler]):
        self.root, self.handlers, self.profiles = options["root"].rstrip("/"), handlers, options.get("as", "files") == "profiles"
        self.ignored = set(options["ignored"].split(",")) if "ignored" in options else set(IGNORED)

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def partitions(self) -> list[Part]:
        store, root = self._store()
        parts, held, size = [], [], 0
        for path, n in find_files(store, root, set(self.handlers), self.ignored):
            if held and (size + n > PART_BYTES or len(held) >= PART_FILES):
                parts.append(Part(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*parts, Part(tuple(held))]

    def read(self, part: Part):
        store, root = self._store()
        columns = [c.split()[0] for c in PROFILE.split(", ")]
        for path in part.paths:
            with store.open_input_file(f"{root}/{path}") as f:
                content = f.read()
            if not self.profiles:
                yield path, content
                continue
            for row in self.handlers[suffix_of(path)](path, content):
                yield tuple(_plain(row[c]) for c in columns)


def _plain(x):
    """Rows of a data source hold tuples for structs."""
    if isinstance(x, list):
        return [tuple(v.values()) if isinstance(v, dict) else v for v in x]
    return x


def register(spark: SparkSession, handlers: dict[str, Handler] | None = None, name: str = "source_files") -> None:
    """Make the source known to the session under a name, with handlers by suffix."""
    chosen, called = dict(handlers or HANDLERS), name

    class SourceFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return called

        def schema(self) -> str:
            return PROFILE if self.options.get("as", "files") == "profiles" else "path string, content binary"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), chosen)

    spark.dataSource.register(SourceFiles)


def read_files(spark: SparkSession, root: str, ignored: list[str] | None = None, handlers: dict[str, Handler] | None = None) -> DataFrame:
    """path (below root), content of the files that a handler is registered for."""
    return _load(spark, root, ignored, handlers, "files")


def read_profiles(spark: SparkSession, root: str, ignored: list[str] | None = None, handlers: dict[str, Handler] | None = None) -> DataFrame:
    """Profiles of the files below root, by the handlers of their suffixes."""
    return _load(spark, root, ignored, handlers, "profiles")


def _load(spark: SparkSession, root: str, ignored: list[str] | None, handlers: dict[str, Handler] | None, kind: str) -> DataFrame:
    register(spark, handlers)
    reader = spark.read.format("source_files").option("root", root).option("as", kind)
    return (reader if ignored is None else reader.option("ignored", ",".join(ignored))).load()


def write_files(files: DataFrame, root: str) -> int:
    """Write files (path, content) below root, each by the task that has it; how many there are."""

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                store.create_dir(f"{at}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{at}/{path}") as out:
                    out.write(content.encode() if isinstance(content, str) else content)
            yield pd.DataFrame({"n": [len(b)]})

    return files.select("path", "content").mapInPandas(run, "n long").agg({"n": "sum"}).first()[0] or 0
