"""Trees listed by the tasks: a data source whose partitions are subtrees.

    spark.read.format("source_tree").option("path", root).load()

The driver lists the top of the tree, level by level, until there are enough directories for all tasks; each task then
walks its share. A directory that is ignored, by the built-in names or by the rules of the root, is never listed. Files
are named by their path, and told apart by size and time of change; nothing is read from them.

Rows: path, rel (below the root), ext, size, modified (nanoseconds). Options: path; extensions (a comma list; by default
those with a parser; `*` for all); partitions (subtrees at least, if the tree has as many); strict (`true`: no rules).
Trees are local to the machines that list them, as a mounted file system is, or in a store that Arrow opens by its
address. A link to a directory inside the tree is not followed, as the directory is listed itself; others are, once.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvine.sources.ignore import IGNORED_DIRECTORIES, IGNORED_EXTENSIONS, Rule, is_ignored, parse_rules
from corvine.sources.parsers import REGISTRY, extension_of

SCHEMA = "path string, rel string, ext string, size bigint, modified bigint"
RULES_FILE = ".gitignore"
PARTITIONS = 64


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    directory: bool
    size: int
    modified: int


class LocalTree:
    """A tree of the local file system, or of one that is mounted."""

    def __init__(self, root: str) -> None:
        self.root, self.seen = os.path.realpath(root, strict=True), set()

    def entries(self, path: str) -> Iterator[Entry]:
        for e in sorted(os.scandir(path), key=lambda e: e.name):
            try:
                info = e.stat()
            except FileNotFoundError:  # gone since it was listed, or a link to nothing
                continue
            if stat.S_ISDIR(info.st_mode):
                if e.is_symlink():
                    real, here = os.path.realpath(e.path), os.path.realpath(path)
                    inside, above = f"{real}/".startswith(f"{self.root}/"), f"{here}/".startswith(f"{real}/")
                    if inside or above or f"{self.root}/".startswith(f"{real}/") or real in self.seen:
                        continue
                    self.seen.add(real)
                yield Entry(e.name, e.path, True, 0, 0)
            elif stat.S_ISREG(info.st_mode):
                yield Entry(e.name, e.path, False, info.st_size, info.st_mtime_ns)

    def text(self, path: str) -> str | None:
        try:
            with open(path, encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError:
            return None


class StoredTree:
    """A tree of another store, by its address."""

    def __init__(self, root: str) -> None:
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(root)

    def entries(self, path: str) -> Iterator[Entry]:
        from pyarrow import fs

        for info in sorted(self.store.get_file_info(fs.FileSelector(path)), key=lambda i: i.base_name):
            if info.type == fs.FileType.Directory:
                yield Entry(info.base_name, info.path, True, 0, 0)
            elif info.type == fs.FileType.File:
                yield Entry(info.base_name, info.path, False, info.size, info.mtime_ns or 0)

    def text(self, path: str) -> str | None:
        try:
            with self.store.open_input_stream(path) as f:
                return f.read().decode()
        except FileNotFoundError:
            return None


def open_tree(root: str) -> LocalTree | StoredTree:
    if root.startswith("file:"):
        return LocalTree("/" + root.removeprefix("file:").lstrip("/"))
    return StoredTree(root) if "://" in root else LocalTree(root)


@dataclass
class Subtrees(InputPartition):
    """Directories to walk by the rules, and files that are known already."""

    directories: list[str]
    files: list[tuple]
    rules: list[Rule]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        """rules are those of the tree, found when its partitions are planned."""
        self.root = options["path"]
        wanted = options.get("extensions", ",".join(REGISTRY))
        self.extensions = None if wanted == "*" else {x.strip() for x in wanted.split(",")}
        self.strict, self.at_least = options.get("strict", "false").lower() == "true", int(options.get("partitions", PARTITIONS))
        self.rules: list[Rule] = []

    def _rel(self, tree, path: str) -> str:
        return path[len(tree.root) :].lstrip("/")

    def _listed(self, tree, path: str) -> tuple[list[str], list[tuple]]:
        """Directories to go into and files to give, of one directory."""
        inner, files = [], []
        for e in tree.entries(path):
            rel = self._rel(tree, e.path)
            if is_ignored(self.rules, rel, e.directory):
                continue
            ext = extension_of(e.name)
            if e.directory:
                if e.name not in IGNORED_DIRECTORIES:
                    inner.append(e.path)
            elif ext not in IGNORED_EXTENSIONS and (self.extensions is None or ext in self.extensions):
                files.append((e.path, rel, ext, e.size, e.modified))
        return inner, files

    def partitions(self) -> list[Subtrees]:
        tree = open_tree(self.root)
        text = None if self.strict else tree.text(f"{tree.root}/{RULES_FILE}")
        self.rules = parse_rules(text) if text else []
        level, files = [tree.root], []
        while level and len(level) < self.at_least:
            below = []
            for path in level:
                inner, found = self._listed(tree, path)
                below += inner
                files += found
            level = below
        parts = [Subtrees(level[k :: self.at_least], files[k :: self.at_least], self.rules) for k in range(self.at_least)]
        return [p for p in parts if p.directories or p.files] or parts[:1]

    def read(self, partition: Subtrees) -> Iterator[tuple]:
        yield from partition.files
        self.rules = partition.rules  # of the reader that planned
        tree, todo = open_tree(self.root), list(partition.directories)
        while todo:
            inner, files = self._listed(tree, todo.pop())
            todo += inner
            yield from files


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def list_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """path, rel, ext, size, modified of a tree's files; options as above."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(path=root, **options).load()
