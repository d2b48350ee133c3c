"""Blocks of single-file components: the template, then the script, then the setup script."""

from __future__ import annotations

from corvine.sources.parsers.script import Flavour, parse_script

EXTENSIONS = ("vue",)


def section(text: str, tag: str) -> tuple[str, int, int, bool] | None:
    """Content, first and last line, and whether it is TypeScript; by text search, as for columns."""
    close = "</script>" if tag == "script setup" else f"</{tag}>"
    at = 0
    while True:
        start = text.find(f"<{tag}", at)
        stop = text.find(">", start) if start >= 0 else -1
        if stop < 0:
            return None
        opening = text[start : stop + 1]
        if tag != "script" or "setup" not in opening:
            break
        at = stop + 1
    end = text.find(close, stop + 1)
    if end < 0:
        return None
    typed = 'lang="ts"' in opening or "lang='ts'" in opening
    return text[stop + 1 : end], text.count("\n", 0, stop + 1) + 1, text.count("\n", 0, end) + 1, typed


def parse(path: str, text: str, extension: str = "vue") -> list[dict]:
    out = []
    found = section(text, "template")
    if found:
        out.append(
            {
                "file_path": path,
                "start_line": found[1],
                "end_line": found[2],
                "content": found[0],
                "language": "vue",
                "kind": "Other",
                "name": "template",
                "parent": None,
                "signature": None,
                "annotations": [],
                "dependencies": [],
            }
        )
    for tag in ("script", "script setup"):
        found = section(text, tag)
        if found:
            flavour = Flavour("vue", members=False, macros=True, setup=tag == "script setup", offset=found[1])
            out += parse_script(path, found[0], flavour)
    return out
