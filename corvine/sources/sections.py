"""Sections of single-file components by text search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def section(text: Column, tag: str) -> Column:
    """The first <tag ...> up to the first closing tag after it: struct(content, start_line, end_line,
    is_typescript), NULL without. 'script' passes over tags that mention setup; 'script setup' closes as script."""
    close = "</script>" if tag == "script setup" else f"</{tag}>"
    if tag == "script":
        tags = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)(<script[^>]*>)"), F.lit(1)), lambda t: ~F.contains(t, F.lit("setup")))
        opening = F.get(tags, F.lit(0))
    else:
        opening = F.nullif(F.regexp_extract(text, rf"(?s)(<{tag}[^>]*>)", 1), F.lit(""))
    start = F.instr(text, opening)
    begin = start + F.length(opening)
    rest = F.substring(text, begin, F.length(text))
    stop = F.instr(rest, F.lit(close))
    content = F.substring(rest, F.lit(1), stop - 1)
    lines = lambda s: F.size(F.split(s, "\n", -1))
    found = F.struct(
        content.alias("content"),
        lines(F.substring(text, F.lit(1), begin - 1)).alias("start_line"),
        lines(F.substring(text, F.lit(1), begin + stop - 2)).alias("end_line"),
        (F.contains(opening, F.lit('lang="ts"')) | F.contains(opening, F.lit("lang='ts'"))).alias("is_typescript"),
    )
    return F.when(opening.isNotNull() & (stop > 0), found)
