"""A stream of file changes: each batch is the difference between two snapshots of a tree.

The offset is the snapshot itself (path to modification time), so a batch can be made again after a restart.
Rows name files only; their contents are read by the tasks that parse them. A batch has at most
maxFilesPerTrigger changes, the rest follows in the next ones. Ignore rules hold, and a file that vanishes, or
comes to be ignored, is a removal. strict=True follows file names alone: rules are not applied to changes, and
removals are seen for supported files only.
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from corvine.sources.parsers import supported
from corvine.sources.scan import walk

SCHEMA = "seq bigint, path string, op string"


def snapshot(root: str, strict: bool = False) -> dict[str, int]:
    out = {}
    for p in walk(root, [] if strict else None):
        if supported(p):
            try:
                out[p] = os.stat(p).st_mtime_ns
            except FileNotFoundError:  # gone since it was listed
                continue
    return out


def difference(old: dict[str, int], new: dict[str, int], most: int | None = None) -> list[tuple]:
    """Rows (seq, path, op), removals first; the first `most` of them."""
    rows = [(path, "remove") for path in sorted(old.keys() - new.keys())]
    rows += [(path, "upsert") for path in sorted(p for p, t in new.items() if old.get(p) != t)]
    return [(i, *r) for i, r in enumerate(rows[:most])]


def advance(old: dict[str, int], new: dict[str, int], rows: list[tuple]) -> dict[str, int]:
    """The old snapshot after these changes."""
    out = dict(old)
    for _, path, op in rows:
        if op == "remove":
            del out[path]
        else:
            out[path] = new[path]
    return out


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, strict: bool, most: int | None) -> None:
        self.root, self.strict, self.most = root, strict, most

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict):
        now = snapshot(self.root, self.strict)
        rows = difference(start, now, self.most)
        return iter(rows), advance(start, now, rows)

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(difference(start, end))

    def commit(self, end: dict) -> None:
        pass


class TreeChanges(DataSource):
    """spark.readStream.format("tree_changes").option("path", root)"""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema):
        most = self.options.get("maxFilesPerTrigger")
        return _Reader(self.options["path"], self.options.get("strict", "false").lower() == "true", int(most) if most else None)
