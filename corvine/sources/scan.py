"""Source trees as tables of files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.text import extension
from corvine.sources.ignore import IGNORED_DIRECTORIES, IGNORED_EXTENSIONS, Rule, ignored, is_ignored, parse_rules
from corvine.sources.parsers import REGISTRY, extension_of

RULES_FILE = ".gitignore"


def load_rules(root: str) -> list[Rule]:
    """Rules of the root directory only; none without the file."""
    try:
        with open(os.path.join(root, RULES_FILE), encoding="utf-8") as f:
            return parse_rules(f.read())
    except FileNotFoundError:
        return []


def stored_rules(spark: SparkSession, root: str) -> list[Rule]:
    """load_rules for any store; Spark's own readers pass over names that start with a dot."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{RULES_FILE}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    stream = store.open(path)
    try:
        return parse_rules(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def walk(root: str, rules: list[Rule] | None = None) -> list[str]:
    """Files of a local tree, ignored directories pruned before they are listed. The root must exist; links
    are followed, each real directory once; a directory that cannot be read fails the walk."""
    root = os.path.realpath(root, strict=True)
    rules = load_rules(root) if rules is None else rules
    out, seen, todo = [], {root}, [root]
    while todo:
        here = todo.pop()
        for entry in sorted(os.scandir(here), key=lambda e: e.name):
            rel = os.path.relpath(entry.path, root).replace(os.sep, "/")
            if entry.is_dir():
                real = os.path.realpath(entry.path)
                if entry.name not in IGNORED_DIRECTORIES and not is_ignored(rules, rel, True) and real not in seen:
                    seen.add(real)
                    todo.append(entry.path)
            elif entry.is_file() and extension_of(entry.name) not in IGNORED_EXTENSIONS and not is_ignored(rules, rel, False):
                out.append(entry.path)
    return sorted(out)


def is_excluded(rules: list[Rule], rel: Column) -> Column:
    """The same test for a column of relative file paths."""
    parts = F.split(rel, "/")
    parents = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    )
    built_in = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, IGNORED_DIRECTORIES)))
    above = F.exists(parents, lambda d: ignored(rules, d, F.lit(True)))
    return built_in | above | F.coalesce(extension(rel), F.lit("")).isin(*IGNORED_EXTENSIONS) | ignored(rules, rel, F.lit(False))


def read_tree(spark: SparkSession, root: str, rules: list[Rule] | None = None) -> DataFrame:
    """Supported files of a tree in any store that Spark reads: path, ext, content. Only names are tested
    before the contents of the remaining files are read."""
    root = root.rstrip("/")
    rules = stored_rules(spark, root) if rules is None else rules
    glob = "*.{" + ",".join(sorted(REGISTRY)) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    bare = root.split(":", 1)[-1].lstrip("/") if ":" in root.split("/", 1)[0] else root.lstrip("/")
    rel = F.substring(plain, len(bare) + 3, 1 << 30)
    return files.where(~is_excluded(rules, rel)).select(plain.alias("path"), extension("path").alias("ext"), "content")


def read_files(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """path, ext and content of given files (a list, or a table with the column path), read by the tasks;
    unreadable ones have NULL content."""
    if isinstance(paths, list):
        rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 256)))
    else:
        rows = paths.select("path").repartition("path")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for a in range(0, len(pdf), 64):  # few contents at a time
                part = pdf["path"].iloc[a : a + 64].tolist()
                content = []
                for p in part:
                    try:
                        with open(p, "rb") as f:
                            content.append(f.read())
                    except OSError:
                        content.append(None)
                yield pd.DataFrame({"path": part, "ext": [extension_of(p) for p in part], "content": content})

    return rows.mapInPandas(run, "path string, ext string, content binary")
