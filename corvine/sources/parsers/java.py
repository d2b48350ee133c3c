"""Blocks of Java files.

Points that rest on how a full grammar cuts its nodes: a constructor's signature holds its body; a method
without a body ends its signature in ';'; constants of interfaces give no row; records and annotation types
give no row themselves, their members are read with the outer parent.
"""

from __future__ import annotations

from corvine.sources.parsers.lexer import Tokens, row

EXTENSIONS = ("java",)
_MODIFIERS = {
    "public", "protected", "private", "abstract", "static", "final", "strictfp", "default", "synchronized", "native",
    "transient", "volatile", "sealed",
}


def parse(path: str, text: str) -> list[dict]:
    out: list[dict] = []
    toks = Tokens(text)
    _Walk(path, toks, out).members(0, toks.count, None, "file")
    return out


class _Walk:
    def __init__(self, path: str, toks: Tokens, out: list[dict]) -> None:
        self.path, self.toks, self.out = path, toks, out

    def members(self, i: int, end: int, parent: str | None, inside: str) -> None:
        t = self.toks
        if inside == "enum":
            i = self.constants(i, end, parent)
        while i < end:
            if t.text[i] in (";", "}") and t.kind[i] == "p":
                i += 1
            else:
                i = max(i + 1, self.member(i, end, parent, inside))

    def constants(self, i: int, end: int, parent: str | None) -> int:
        t = self.toks
        while i < end and t.text[i] != ";":
            if t.kind[i] == "p" and t.text[i] in "([{":
                j = t.close(i, end)
                if t.text[i] == "{":
                    self.members(i + 1, j, parent, "class")
                i = j
            i += 1
        return i + 1

    def member(self, first: int, end: int, parent: str | None, inside: str) -> int:
        t = self.toks
        if t.text[first] in ("import", "package") and inside == "file":
            j = first
            while j < end and t.text[j] != ";":
                j += 1
            b = min(j + 1, end)
            if t.text[first] == "import":
                content = t.slice(first, b)
                whole = content.startswith("import ") and content.endswith(";")
                name = content[len("import ") : -1].strip() if whole else content.strip()
                self.out.append(row(self.path, t, first, b, "java", "Import", name))
            return b
        i, notes = first, []
        while i < end:
            if t.text[i] == "@" and i + 1 < end and t.text[i + 1] != "interface":
                j = i + 2
                while j + 1 < end and t.text[j] == ".":
                    j += 2
                if j < end and t.text[j] == "(":
                    j = t.close(j, end) + 1
                notes.append(t.slice(i, j))
                i = j
            elif t.text[i] in _MODIFIERS or (t.text[i] == "non" and t.slice(i, min(i + 3, end)) == "non-sealed"):
                i += 3 if t.text[i] == "non" else 1
            else:
                break
        if i >= end:
            return end
        parts = [t.slice(first, i)] if i > first else []
        word = t.text[i]
        if word in ("class", "interface", "enum") and i + 1 < end and t.kind[i + 1] == "w":
            return self.type(first, i, end, notes, parts, word)
        if word == "record" and i + 2 < end and t.text[i + 2] in ("(", "<") or word == "@":
            return self.silent(i, end, parent)
        if word == "{":
            j = t.close(i, end)
            self.local_types(i + 1, j, parent)
            return j + 1
        return self.callable_or_field(first, i, end, parent, inside, notes, parts)

    def silent(self, i: int, end: int, parent: str | None) -> int:
        t = self.toks
        while i < end and t.text[i] not in ("{", ";"):
            i = (t.close(i, end) if t.text[i] == "(" else i) + 1
        if i < end and t.text[i] == "{":
            j = t.close(i, end)
            self.members(i + 1, j, parent, "class")
            return j + 1
        return i + 1

    def local_types(self, i: int, end: int, parent: str | None) -> None:
        while i < end:
            if self.toks.text[i] == "class" and i + 1 < end and self.toks.kind[i + 1] == "w":
                i = self.member(i, end, parent, "class")
            else:
                i += 1

    def type(self, first: int, i: int, end: int, notes: list[str], parts: list[str], word: str) -> int:
        t = self.toks
        name = t.text[i + 1]
        parts += [word, name]
        j, depends, clause = i + 2, [], None
        if j < end and t.text[j] == "<":
            k = t.angle(j, end)
            parts.append(t.slice(j, k))
            j = k
        while j < end and t.text[j] != "{":
            if t.text[j] in ("extends", "implements", "permits"):
                clause = j
                j += 1
                while j < end and t.text[j] not in ("{", "implements", "permits") and not (t.text[j] == "extends" and j > clause):
                    j = t.angle(j, end) if t.text[j] == "<" else j + 1
                parts.append(t.slice(clause, j))
                if t.text[clause] == "implements" or (t.text[clause] == "extends" and word == "class"):
                    depends.append(t.slice(clause, j))
            else:
                j += 1
        stop = t.close(j, end) if j < end else end - 1
        kind = {"class": "Class", "interface": "Interface", "enum": "Enum"}[word]
        self.out.append(
            row(self.path, t, first, stop + 1, "java", kind, name, None, " ".join(parts), notes, depends)
        )
        self.members(j + 1, stop, name, word)
        return stop + 1

    def callable_or_field(self, first, i, end, parent, inside, notes, parts) -> int:
        t = self.toks
        begin = i
        if t.text[i] == "<":
            i = t.angle(i, end)
            parts.append(t.slice(begin, i))
            begin = i
        j = i
        while j < end and t.text[j] not in ("(", "=", ";", ",", "{", "}"):
            j = t.angle(j, end) if t.text[j] == "<" else j + 1
        if j >= end or j == begin:
            return j + 1
        if t.text[j] == "{":  # a compact constructor, or what is no member
            return t.close(j, end) + 1
        if t.text[j] == "(":
            name = t.text[j - 1]
            close = t.close(j, end) + 1
            parts += [t.slice(begin, j - 1)] if j - 1 > begin else []
            parts += [name, t.slice(j, close)]
            k = close
            while k < end and t.text[k] not in ("{", ";") and t.text[k] != "default":
                k += 1
            parts += [t.slice(close, k)] if k > close else []
            body = k < end and t.text[k] == "{"
            while k < end and t.text[k] not in ("{", ";"):
                k += 1
            stop = t.close(k, end) + 1 if body and k < end else min(k + 1, end)
            constructor = j - 1 == begin
            if constructor and body:
                parts.append(t.slice(k, stop))
            elif not body and k < end:
                parts.append(";")
            kind = "Constructor" if constructor else "Method"
            self.out.append(row(self.path, t, first, stop, "java", kind, name, parent, " ".join(parts), notes))
            return stop
        name_at = j - 1
        while name_at > begin and t.text[name_at] in ("]", "["):
            name_at -= 1
        while j < end and t.text[j] != ";":
            j = (t.close(j, end) if t.kind[j] == "p" and t.text[j] in "([{" else j) + 1
        stop = min(j + 1, end)
        if inside != "interface" and name_at > begin:
            content = t.slice(first, stop)
            self.out.append(
                row(self.path, t, first, stop, "java", "Field", t.text[name_at], parent, content.rstrip(";").strip(), notes)
            )
        return stop
