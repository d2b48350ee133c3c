"""Ignore rules of a source tree: a small subset of the usual file, as both plain and column functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories and extensions that are never read.
IGNORED_DIRECTORIES = (
    ".git", ".svn", ".hg", "target", "build", "dist", "out", "node_modules", ".idea", ".vscode", ".gradle", ".settings",
    "__pycache__", ".DS_Store",
)
IGNORED_EXTENSIONS = (
    "class", "jar", "war", "ear", "zip", "tar", "gz", "rar", "7z", "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "mp3",
    "mp4", "avi", "mov", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "exe", "dll", "so", "dylib", "o", "a", "lock",
)


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool = False
    directories_only: bool = False


def parse_rules(text: str) -> list[Rule]:
    rules = []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        only, line = line.endswith("/"), line.removesuffix("/")
        rules.append(Rule(line, negated, only))
    return rules


def glob_regex(pattern: str) -> str:
    """One star: both ends are anchored. Several: the parts follow each other, the end stays open."""
    parts = pattern.split("*")
    body = ".*".join(map(re.escape, parts))
    return f"(?s)^{body}" + ("" if len(parts) > 2 else "$")


def glob(pattern: str, name: str) -> bool:
    return name == pattern if "*" not in pattern else re.search(glob_regex(pattern), name) is not None


def glob_column(pattern: str, name: Column) -> Column:
    if "*" not in pattern:
        return name == pattern
    parts = pattern.split("*")
    quoted = ".*".join("".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in p) for p in parts)
    return name.rlike(f"(?s)\\A{quoted}" + ("" if len(parts) > 2 else "\\z"))


def is_ignored(rules: list[Rule], path: str, directory: bool) -> bool:
    """The last rule that matches decides. path: relative, without a leading slash."""
    found, name = False, path.rsplit("/", 1)[-1]
    for r in rules:
        if r.directories_only and not directory:
            continue
        hit = path.startswith(r.pattern) or f"/{r.pattern}" in path if "/" in r.pattern else glob(r.pattern, name)
        if hit:
            found = not r.negated
    return found


def ignored(rules: list[Rule], path: Column, directory: Column) -> Column:
    """is_ignored as one expression."""
    found, name = F.lit(False), F.substring_index(path, "/", -1)
    for r in rules:
        if "/" in r.pattern:
            hit = F.startswith(path, F.lit(r.pattern)) | F.contains(path, F.lit(f"/{r.pattern}"))
        else:
            hit = glob_column(r.pattern, name)
        if r.directories_only:
            hit = hit & directory
        found = F.when(hit, F.lit(not r.negated)).otherwise(found)
    return found
