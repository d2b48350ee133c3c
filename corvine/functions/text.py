"""Text expressions: tokens, document texts, lines, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script and the punctuation that separates tokens.
SEPARATORS = r"(?U)[\s.,;(){}<>:/\\]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens; split before lower-casing, as the latter depends on neighbours."""
    return F.transform(F.array_remove(F.split(text, SEPARATORS), ""), F.lower)


def query_terms(text: str) -> list[str]:
    """The tokens of a request, by the same rule, on the driver."""
    out, now = [], ""
    for c in text:
        if c.isspace() and not "\x1c" <= c <= "\x1f" or c in ".,;(){}<>:/\\":
            out.append(now)
            now = ""
        else:
            now += c
    return [t.lower() for t in [*out, now] if t]


def document_text(name="name", content="content", signature="signature", annotations="annotations", parent="parent") -> Column:
    """What keyword search reads of a block: absent parts are skipped, and dependencies are not read."""
    return F.concat_ws(" ", name, content, signature, annotations, parent)


def embedding_text(length: int = 500) -> Column:
    """What a block's vector is made of."""
    head = F.concat_ws(" ", "language", "kind", "name", "signature", "parent", "annotations")
    return F.concat(head, F.lit("\n"), F.substring("content", 1, length))


def lines(text: Column | str) -> Column:
    """Lines without their ends; no empty line after a final line end, and none in an empty text."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_slice(text: Column | str, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both included) joined again."""
    return F.array_join(F.slice(lines(text), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def offset_line(text: Column, offset: Column) -> Column:
    """Line, from 1, of a character offset, from 0."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def snippet(content: Column | str, terms: Column, around: int) -> Column:
    """Lines that contain a term, each with `around` lines on both sides; separate runs are parted by a mark.
    Without a match the whole content."""
    content = F.col(content) if isinstance(content, str) else content
    hit = lambda line: F.exists(terms, lambda t: F.contains(F.lower(line), t))

    def build(all_lines: Column) -> Column:
        # distance to the last match before and to the next one after, by two scans
        def nearest(parts: Column) -> Column:
            start = F.struct(F.lit(1 << 30).alias("d"), F.array().cast("array<int>").alias("all"))

            def step(acc: Column, line: Column) -> Column:
                d = F.when(hit(line), 0).otherwise(acc.d + 1)
                return F.struct(d.alias("d"), F.concat(acc["all"], F.array(d)).alias("all"))

            return F.aggregate(parts, start, step, lambda acc: acc["all"])

        back = F.reverse(nearest(F.reverse(all_lines)))
        near = F.zip_with(nearest(all_lines), back, lambda x, y: F.least(x, y) <= around)
        rows = F.zip_with(all_lines, near, lambda line, shown: F.struct(line.alias("line"), shown.alias("shown")))
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("gap"))

        def step(acc: Column, r: Column) -> Column:
            parted = acc.gap & (F.size(acc["out"]) > 0)
            line = F.when(parted, F.concat(F.lit("  ...\n"), r.line)).otherwise(r.line)
            out = F.when(r.shown, F.concat(acc["out"], F.array(line))).otherwise(acc["out"])
            return F.struct(out.alias("out"), (~r.shown).alias("gap"))

        built = F.aggregate(rows, start, step, lambda acc: F.array_join(acc["out"], "\n"))
        return F.when(F.exists(all_lines, hit), built).otherwise(content)

    return let(lines(content), build)


def extension(path: Column | str) -> Column:
    """The last extension, case kept; NULL without one. A leading dot starts a name, not an extension."""
    name = F.substring_index(path, "/", -1)
    found = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when(found != "", found)


def file_name(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


#: Words that a table name cannot be.
SQL_KEYWORDS = (
    "SELECT", "FROM", "WHERE", "AND", "OR", "INSERT", "INTO", "UPDATE", "SET", "DELETE", "VALUES", "JOIN", "LEFT",
    "RIGHT", "INNER", "OUTER", "ON", "AS", "IN", "NOT", "NULL", "IS", "LIKE", "ORDER", "BY", "GROUP", "HAVING",
    "LIMIT", "OFFSET", "UNION", "ALL", "DISTINCT", "EXISTS", "BETWEEN", "CASE", "WHEN", "THEN", "ELSE", "END",
)


def sql_dependencies(sql: Column | str, before: tuple[str, ...] = ("FROM", "JOIN", "INTO", "UPDATE")) -> Column:
    """Table names after certain words, then param:<x> for every #{x}."""
    sql = F.col(sql) if isinstance(sql, str) else sql
    trim = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_.]+|[^\p{L}\p{N}_.]+$", "")

    def pick(found: Column) -> Column:
        following = F.slice(found, F.lit(2), F.size(found))
        return F.zip_with(found, following, lambda w, n: F.when(F.upper(w).isin(*before) & n.isNotNull(), trim(n)))

    named = let(F.array_remove(F.split(sql, r"(?U)\s+"), ""), pick)
    tables = F.filter(named, lambda w: w.isNotNull() & (w != "") & ~F.upper(w).isin(*SQL_KEYWORDS))
    return F.concat(tables, parameters(sql))


def parameters(sql: Column) -> Column:
    names = F.array_remove(F.regexp_extract_all(sql, F.lit(r"#\{([^}]*)\}"), F.lit(1)), "")
    return F.transform(names, lambda p: F.concat(F.lit("param:"), p))
