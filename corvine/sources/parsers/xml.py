"""Blocks of XML files: statement mappers, and other files down to the second level.

Markup is read by a scanner of its own, as leniently as the format's pull readers do: several roots, none, an
empty file and plain text are fine, entities are not resolved outside of a mapper's SQL, attribute values stay
as written, any declared encoding is read as UTF-8, and elements may be open at the end. A start line is that
of the end of the start tag. An end tag without its start, and markup that does not end, reject the file.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from corvine.functions.text import SQL_KEYWORDS

EXTENSIONS = ("xml",)
STATEMENTS = ("select", "insert", "update", "delete")
DEFINITIONS = ("resultMap", "sql")
_KEYWORDS = frozenset(SQL_KEYWORDS)


def sql_dependencies(sql: str) -> list[str]:
    """The same rule as the column function."""
    words = sql.split()
    after = [b for a, b in zip(words, words[1:], strict=False) if a.upper() in ("FROM", "JOIN", "INTO", "UPDATE")]
    tables = [re.sub(r"^[^\w.]+|[^\w.]+$", "", w) for w in after]
    return [w for w in tables if w and w.upper() not in _KEYWORDS] + [f"param:{p}" for p in re.findall(r"#\{([^}]*)\}", sql) if p]


def parse(path: str, text: str, extension: str = "xml") -> list[dict]:
    return _Reader(path, text).read("<mapper" in text and "namespace" in text)


class MarkupError(ValueError):
    pass


#: Where a start tag ends, past quoted values.
_TAG = re.compile(r"""[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*>""")
_ATTRIBUTE = re.compile(r"""([^ \t\r\n=]+)[ \t\r\n]*(?:=[ \t\r\n]*(?:"([^"]*)"|'([^']*)'|[^ \t\r\n]*))?""")
_NAME = re.compile(r"[^ \t\r\n]*")
_REFERENCE = re.compile(r"&([^;&]*)(;?)")
#: The entities that need no declaration.
_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}


def attributes(text: str) -> list[tuple[str, str]]:
    """Quoted attributes as written; a name counts once, and one without a quoted value not at all."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = m[2] if m[2] is not None else m[3]
        if value is not None:
            out.setdefault(m[1], value)
    return list(out.items())


def resolved(text: str) -> str:
    """A text with its references resolved; empty if one of them is not known."""

    def put(m: re.Match) -> str:
        name = m[1]
        if not m[2]:
            raise MarkupError("reference without end")
        if name in _ENTITIES:
            return _ENTITIES[name]
        if not re.fullmatch(r"#(?:[0-9]+|x[0-9a-fA-F]+)", name):
            raise MarkupError(f"unknown entity {name}")
        code = int(name[2:], 16) if name[1] == "x" else int(name[1:])
        if code == 0 or code > 0x10FFFF or 0xD800 <= code < 0xE000:
            raise MarkupError(f"no character {name}")
        return chr(code)

    try:
        return _REFERENCE.sub(put, text)
    except MarkupError:
        return ""


def events(text: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name, rest, offset after it) of start, empty and end tags and of texts between markup."""
    at, open_tags = 0, []

    def until(mark: str, begin: int) -> int:
        found = text.find(mark, begin)
        if found < 0:
            raise MarkupError(f"markup at {at} does not end")
        return found + len(mark)

    while at < len(text):
        begin = text.find("<", at)
        if begin != at:
            stop = len(text) if begin < 0 else begin
            yield "text", "", text[at:stop], stop
            at = stop
        elif text.startswith("<!--", at):
            at = until("-->", at + 4)
        elif text.startswith("<![CDATA[", at):
            at = until("]]>", at + 9)
        elif text.startswith("<!", at):
            if text[at + 2 : at + 9].upper() != "DOCTYPE":
                raise MarkupError(f"unknown markup at {at}")
            depth, at_end = 0, at
            while True:  # a document type may hold declarations
                m = re.compile("[<>]").search(text, at_end)
                if m is None:
                    raise MarkupError(f"markup at {at} does not end")
                depth, at_end = depth + (1 if m[0] == "<" else -1), m.end()
                if depth == 0:
                    break
            at = at_end
        elif text.startswith("<?", at):
            at = until("?>", at + 2)
        elif text.startswith("</", at):
            stop = until(">", at)
            name = text[at + 2 : stop - 1].rstrip(" \t\r\n")
            if not open_tags or open_tags.pop() != name:
                raise MarkupError(f"end tag {name} without its start")
            at = stop
            yield "end", name, "", at
        else:
            m = _TAG.match(text, at + 1)
            if m is None:
                raise MarkupError(f"tag at {at} does not end")
            at = m.end()
            inner = m[0][:-1]
            kind = "empty" if inner.endswith("/") else "start"
            inner = inner[:-1] if kind == "empty" else inner
            name = _NAME.match(inner)[0]
            if kind == "start":
                open_tags.append(name)
            yield kind, name, inner[len(name) :], at


class _Reader:
    def __init__(self, path: str, text: str) -> None:
        self.path, self.text = path, text.removeprefix("\ufeff")
        self.lines = text.replace("\r\n", "\n").split("\n")
        self.breaks = [m.start() for m in re.finditer("\n", self.text)]
        self.out: list[dict] = []

    def line(self, offset: int) -> int:
        return bisect.bisect_left(self.breaks, offset) + 1

    def add(self, start: int, end: int, kind: str, name: str, content: str | None, parent, signature: str, depends=()) -> None:
        self.out.append(
            {
                "file_path": self.path,
                "start_line": start,
                "end_line": end,
                "content": "\n".join(self.lines[start - 1 : end]) if content is None else content,
                "language": "xml",
                "kind": kind,
                "name": name,
                "parent": parent,
                "signature": signature,
                "annotations": [],
                "dependencies": list(depends),
            }
        )

    def read(self, mapper: bool) -> list[dict]:
        (self.mapper if mapper else self.plain)()
        return self.out

    def plain(self) -> None:
        depth = 0
        for kind, tag, rest, stop in events(self.text):
            if kind == "end":
                depth = max(depth - 1, 0)
            depth += kind == "start"
            if kind in ("start", "empty") and depth + (kind == "empty") <= 2:
                pairs = attributes(rest)
                name = [v for k, v in pairs if k in ("id", "name")][-1:] or [""]
                inner = "".join(f' {k}="{v}"' for k, v in pairs)
                self.add(self.line(stop), self.line(stop), "XmlNode", name[0] or tag, None, None, f"<{tag}{inner}{'/' * (kind == 'empty')}>")

    def mapper(self) -> None:
        namespace, sql = "", []
        statement = definition = None  # (tag, id, attributes, start line)
        for kind, tag, rest, stop in events(self.text):
            at = self.line(stop)
            if kind == "text" and statement:
                sql.append(resolved(rest))
            elif kind == "start":
                pairs = attributes(rest)
                own = tag, dict(pairs).get("id", ""), " ".join(f'{k}="{v}"' for k, v in pairs), at
                if tag == "mapper":
                    for v in (v for k, v in pairs if k == "namespace"):
                        namespace = v
                        self.add(at, at, "XmlNamespace", v, f'<mapper namespace="{v}">', None, f"namespace: {v}")
                elif tag in STATEMENTS:
                    statement, sql = own, []
                elif tag in DEFINITIONS:
                    definition = own
            elif kind == "end":
                for found in (statement, definition):
                    if found and found[0] == tag:
                        _, own_id, inner, first = found
                        depends = sql_dependencies("".join(sql)) if found is statement else ()
                        self.add(first, at, "XmlNode", own_id, None, namespace, f"<{tag} {inner}>", depends)
                statement = None if statement and statement[0] == tag else statement
                definition = None if definition and definition[0] == tag else definition
