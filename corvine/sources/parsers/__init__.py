"""Parsers by extension. A parser is a function (path, text, extension) -> list of block rows."""

from __future__ import annotations

from collections.abc import Callable

from corvine.sources.parsers import java, script, vue, xml

REGISTRY: dict[str, Callable[[str, str, str], list[dict]]] = {}


def register(extensions: tuple[str, ...], parse: Callable[[str, str, str], list[dict]]) -> None:
    """The first parser of an extension stays."""
    for e in extensions:
        REGISTRY.setdefault(e, parse)


register(java.EXTENSIONS, lambda path, text, ext: java.parse(path, text))
register(script.EXTENSIONS, script.parse)
register(vue.EXTENSIONS, vue.parse)
register(xml.EXTENSIONS, xml.parse)


def extension_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1] if "." in name[1:] else None


def supported(path: str) -> bool:
    return extension_of(path) in REGISTRY


def parse_file(path: str, content: bytes | None) -> tuple[list[dict], str | None]:
    """Rows, and an error if the file cannot be read."""
    try:
        ext = extension_of(path)
        return REGISTRY[ext](path, content.decode("utf-8"), ext), None
    except Exception as e:  # one file's failure is a row of the file table, not the job's
        return [], f"{type(e).__name__}: {e}"[:500]
