"""Blocks of JavaScript and TypeScript files, and of the scripts in components.

Statements end by the usual rules, automatic semicolons included. What is not a declaration is searched for
declarations in its blocks and for methods in its object literals. Points that rest on how a full grammar
cuts its nodes: a field ends before its semicolon; abstract classes give no row and their members keep the
outer parent; signatures without a body give no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from corvine.sources.parsers.lexer import Tokens, row

EXTENSIONS = ("js", "jsx", "ts", "tsx")
MACROS = ("defineProps", "defineEmits", "defineExpose", "defineSlots")
_MEMBER_WORDS = {
    "static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor",
}
_GOES_ON = {
    "=", ",", ".", "?.", "+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", "=>", "==", "===", "!=", "!==", "<=", ">=", "<",
    ">", "&", "|", "^", "in", "instanceof", "as", "extends",
}


@dataclass(frozen=True)
class Flavour:
    """What differs between plain scripts and scripts of components."""

    label: str
    typed: bool = True  # interfaces and enums give rows
    members: bool = True  # fields and decorators are read
    macros: bool = False  # compiler macros in declarations give rows
    setup: bool = False  # and bare macro statements too
    offset: int = 1  # line number of the first line


def parse(path: str, text: str, extension: str = "js") -> list[dict]:
    typed = extension in ("ts", "tsx")
    return parse_script(path, text, Flavour("typescript" if typed else "javascript", typed))


def parse_script(path: str, text: str, flavour: Flavour) -> list[dict]:
    out: list[dict] = []
    toks = Tokens(text, script=True)
    _Walk(path, toks, flavour, out).statements(0, toks.count, None)
    return out


class _Walk:
    def __init__(self, path: str, toks: Tokens, flavour: Flavour, out: list[dict]) -> None:
        self.path, self.t, self.f, self.out = path, toks, flavour, out

    def add(self, a: int, b: int, kind: str, name: str, parent=None, signature=None, notes=(), depends=()) -> dict:
        notes = notes if self.f.members else ()
        r = row(self.path, self.t, a, b, self.f.label, kind, name, parent, signature, notes, depends, self.f.offset)
        self.out.append(r)
        return r

    # statements

    def statements(self, i: int, end: int, parent: str | None) -> None:
        while i < end:
            i = max(i + 1, self.statement(i, end, parent))

    def statement(self, i: int, end: int, parent: str | None) -> int:
        t = self.t
        first, notes = i, []
        while i < end and t.text[i] == "@" and i + 1 < end:
            j = self.decorator(i, end)
            notes.append(t.slice(i, j))
            i = j
        if i >= end:
            return end
        word, after = t.text[i], t.text[i + 1] if i + 1 < end else ""
        if word == "import" and after not in ("(", "."):
            return self.imports(i, end)
        if word == "export":
            return self.exports(first, i, end, parent, notes)
        found = self.declaration(first, i, end, parent, notes)
        if found:
            return found
        stop = self.ends(i, end)
        if self.f.setup and word not in ("if", "for", "while", "switch", "try", "return", "{"):
            content = t.slice(i, stop)
            for m in MACROS:
                if m in content:
                    self.add(i, stop, "Other", m, None, content.strip().rstrip(";"))
                    break
        return self.search(i, stop, parent)

    def decorator(self, i: int, end: int) -> int:
        t = self.t
        j = i + 2
        while j + 1 < end and t.text[j] == ".":
            j += 2
        return t.close(j, end) + 1 if j < end and t.text[j] == "(" else j

    def imports(self, i: int, end: int) -> int:
        t = self.t
        j = i + 1
        while j < end and t.kind[j] != "s" and t.text[j] != ";" and not (t.new_line(j) and t.text[j - 1] not in ("{", ",", "from", "import") and t.text[j] not in ("}", "from")):
            j = (t.close(j, end) if t.text[j] == "{" else j) + 1
        source = t.text[j] if j < end and t.kind[j] == "s" else None
        j += source is not None
        if j < end and t.text[j] in ("with", "assert") and j + 1 < end and t.text[j + 1] == "{":
            j = t.close(j + 1, end) + 1
        j += j < end and t.text[j] == ";"
        self.add(i, j, "Import", source.strip("'\"") if source is not None else t.slice(i, j))
        return j

    def declaration(self, first: int, i: int, end: int, parent, notes) -> int:
        """Index after a declaration that starts at i, or 0."""
        t = self.t
        word, after = t.text[i], t.text[i + 1] if i + 1 < end else ""
        if word in ("declare",) and after in ("class", "interface", "enum", "const", "let", "var", "function"):
            return self.declaration(first, i + 1, end, parent, notes)
        if word == "abstract" and after == "class":
            j = self.body_at(i, end)
            if j < end:
                self.class_body(j + 1, t.close(j, end), parent)
                return t.close(j, end) + 1
            return j
        if word == "class" and i + 1 < end and t.kind[i + 1] == "w" and after != "extends":
            return self.type(first, i, end, "Class", notes)
        if word == "interface" and self.f.typed and i + 1 < end and t.kind[i + 1] == "w":
            return self.type(first, i, end, "Interface", notes)
        if word == "enum" and self.f.typed and i + 1 < end and t.kind[i + 1] == "w":
            return self.type(first, i, end, "Enum", notes)
        if word == "const" and after == "enum" and self.f.typed:
            return self.type(first, i + 1, end, "Enum", notes)
        j = i + (word == "async" and after == "function")
        if t.text[j] == "function":
            k = j + 1 + (j + 1 < end and t.text[j + 1] == "*")
            if k < end and t.kind[k] == "w":
                return self.function(first, i, j, k, end, parent)
        if word in ("const", "let", "var") and i + 1 < end and (t.kind[i + 1] == "w" or after in ("{", "[")):
            return self.variables(i, end, parent)
        return 0

    def body_at(self, i: int, end: int) -> int:
        t = self.t
        while i < end and t.text[i] != "{":
            if t.text[i] == "<":
                i = t.angle(i, end)
            elif t.text[i] in ("(", "["):
                i = t.close(i, end) + 1
            elif t.text[i] == ";":
                return end
            else:
                i += 1
        return i

    def type(self, first: int, i: int, end: int, kind: str, notes) -> int:
        t = self.t
        j = self.body_at(i, end)
        if j >= end:
            return end
        stop = t.close(j, end)
        name, parts, k = t.text[i + 1], [], i + 2
        parts += [t.text[x] for x in range(i - (t.text[i - 1] == "const" and kind == "Enum" and i > first), i + 2)]
        if k < j and t.text[k] == "<":
            e = t.angle(k, j)
            parts.append(t.slice(k, e))
            k = e
        heritage = [t.slice(k, j)] if j > k else []
        self.add(first, stop + 1, kind, name, None, " ".join(parts + heritage), notes, heritage if kind == "Class" else ())
        if kind == "Class":
            self.class_body(j + 1, stop, name)
        return stop + 1

    def signature(self, i: int, name: int, end: int) -> tuple[str, int]:
        """Parts from i to the body or end of a function whose name is at `name`; index of what follows."""
        t = self.t
        parts = [t.text[k] for k in range(i, name)]
        j = name + 1
        if t.text[name] == "[":
            j = t.close(name, end) + 1
        if j < end and t.text[j] in ("?", "!"):
            j += 1
        parts.append(t.slice(name, j))
        if j < end and t.text[j] == "<":
            k = t.angle(j, end)
            parts.append(t.slice(j, k))
            j = k
        if j < end and t.text[j] == "(":
            k = t.close(j, end) + 1
            parts.append(t.slice(j, k))
            j = k
        if j < end and t.text[j] == ":":
            k = j + 1
            while k < end and t.text[k] != ";" and not (t.text[k] == "{" and t.text[k - 1] not in (":", "|", "&", "<", ",", "=>")):
                if t.text[k] in ("{", "(", "["):
                    k = t.close(k, end) + 1
                elif t.text[k] == "<":
                    k = t.angle(k, end)
                elif t.text[k] == "}" or t.new_line(k) and t.text[k - 1] not in (":", "|", "&") and t.text[k] not in ("|", "&", "{"):
                    break
                else:
                    k += 1
            parts.append(t.slice(j, k))
            j = k
        return " ".join(parts), j

    def function(self, first: int, i: int, word: int, name: int, end: int, parent) -> int:
        t = self.t
        sig, j = self.signature(i, name, end)
        if j >= end or t.text[j] != "{":  # an overload or a declaration without a body
            return j + (j < end and t.text[j] == ";")
        stop = t.close(j, end) + 1
        self.add(i, stop, "Method", t.text[name], parent, sig)
        return stop

    def ends(self, i: int, end: int) -> int:
        """Index after the statement that starts at i."""
        t = self.t
        j = i
        while j < end:
            x = t.text[j]
            if t.kind[j] == "p":
                if x == ";":
                    return j + 1
                if x in "([{":
                    j = t.close(j, end)
                    if x == "{" and self.is_block(i, j, end):
                        return j + 1
                elif x in ")]}":
                    return j + 1
            j += 1
            if j < end and t.new_line(j) and t.text[j - 1] not in _GOES_ON and t.text[j] not in _GOES_ON and t.text[j] not in ("(", "[", "{"):
                return j
        return end

    def is_block(self, i: int, close: int, end: int) -> bool:
        """Whether the braces that end at close are the body of a statement rather than part of an expression."""
        t = self.t
        opens = t.partner[close]
        if opens <= i:
            return True
        before = t.text[opens - 1]
        following = t.text[close + 1] if close + 1 < end else ""
        return before in (")", "else", "try", "finally", "do") and t.text[i] in ("if", "for", "while", "switch", "try", "else", "do", "with") and following not in ("else", "catch", "finally", "while")

    # exports

    def exports(self, first: int, i: int, end: int, parent, notes) -> int:
        t = self.t
        j = i + 1
        if j < end and t.text[j] == "default":
            j += 1
        while j < end and t.text[j] == "@":
            k = self.decorator(j, end)
            notes = [*notes, t.slice(j, k)]
            j = k
        before = len(self.out)
        stop = self.declaration(j, j, end, parent, notes) if j < end else 0
        if stop:
            made = self.out[before:]
            word = t.text[j]
            own = made if word in ("const", "let", "var") and not (made and made[0]["kind"] == "Enum") else made[:1]
            if made or word in ("const", "let", "var"):
                for r in own:
                    r["start_line"] = t.line(t.start[first]) + self.f.offset - 1
                    r["content"] = t.slice(first, stop)
                if word == "interface" and not self.f.members:
                    del self.out[before + 1 :]
                return stop
        stop = self.ends(i, end)
        if j < end and t.text[j] in ("class", "function", "async") and not t.text[j - 1] == "export":
            k = self.body_at(j, end)
            stop = t.close(k, end) + 1 if k < end else stop
        self.add(first, stop, "Other", "export")
        return stop

    # variables

    def variables(self, i: int, end: int, parent) -> int:
        t = self.t
        stop = self.ends(i, end)
        j = i + 1
        limit = stop - (t.text[stop - 1] == ";")
        while j < limit:
            name_end = t.close(j, limit) + 1 if t.text[j] in ("{", "[") else j + 1
            name, kind_text, k = t.slice(j, name_end), None, name_end
            if k < limit and t.text[k] == "!":
                k += 1
            if k < limit and t.text[k] == ":":
                a = k
                while k < limit and t.text[k] not in ("=", ","):
                    k = t.close(k, limit) + 1 if t.text[k] in ("{", "(", "[") else t.angle(k, limit) if t.text[k] == "<" else k + 1
                kind_text = t.slice(a, k)
            if k < limit and t.text[k] == "=":
                self.value(i, stop, k + 1, limit, name, kind_text, parent)
            while k < limit and t.text[k] != ",":
                if t.text[k] == "<" and t.kind[k - 1] == "w" and t.text[t.angle(k, limit) - 1] == ">":
                    k = t.angle(k, limit)
                else:
                    k = (t.close(k, limit) if t.text[k] in ("{", "(", "[") else k) + 1
            j = k + 1
        return stop

    def value(self, i: int, stop: int, v: int, limit: int, name: str, kind_text, parent) -> None:
        t = self.t
        if v >= limit:
            return
        k = v + (t.text[v] == "async" and v + 1 < limit)
        params = None
        if t.text[k] == "function":
            p = k + 1
            if p < limit and t.text[p] == "*":
                return  # a generator expression is neither form
            p += p < limit and t.kind[p] == "w"
            if p < limit and t.text[p] == "<":
                p = t.angle(p, limit)
            params = t.slice(p, t.close(p, limit) + 1) if p < limit and t.text[p] == "(" else ""
        else:
            p = t.angle(k, limit) if t.text[k] == "<" else k
            if p < limit and t.text[p] == "(":
                e = t.close(p, limit) + 1
                q = e
                if q < limit and t.text[q] == ":":
                    while q < limit and t.text[q] not in ("=>", ";", ","):
                        q = t.close(q, limit) + 1 if t.text[q] in ("{", "(", "[") else t.angle(q, limit) if t.text[q] == "<" else q + 1
                if q < limit and t.text[q] == "=>":
                    params = t.slice(p, e)
            elif k + 1 < limit and t.kind[k] == "w" and t.text[k + 1] == "=>":
                params = ""  # a bare parameter prints no list
        if params is not None:
            sig = name + (f": {kind_text}" if kind_text else "") + (f" = {params} => ..." if params else "")
            self.add(i, stop, "Method", name, parent, sig)
        elif self.f.macros and v + 1 < limit and t.text[v] in (*MACROS, "withDefaults") and t.text[v + 1] in ("(", "<"):
            content = t.slice(i, stop)
            self.add(i, stop, "Other", "defineProps" if t.text[v] == "withDefaults" else t.text[v], None, content.strip().rstrip(";"))

    # what is inside other statements

    def search(self, i: int, end: int, parent) -> int:
        t = self.t
        while i < end:
            if t.kind[i] == "p" and t.text[i] == "{":
                j = t.close(i, end)
                if self.is_object(i):
                    self.object(i + 1, j, parent)
                else:
                    self.statements(i + 1, j, parent)
                i = j
            elif t.text[i] == "class" and t.kind[i] == "w" and (j := self.body_at(i, end)) < end and t.text[j] == "{":
                self.class_body(j + 1, t.close(j, end), parent)
                i = t.close(j, end)
            i += 1
        return end

    def is_object(self, i: int) -> bool:
        before = self.t.text[i - 1] if i else ";"
        return before in ("(", ",", "=", ":", "[", "?", "&&", "||", "??", "return", "default", "...", "await")

    def object(self, i: int, end: int, parent) -> None:
        t = self.t
        while i < end:
            j = i
            while j < end and t.text[j] in ("async", "get", "set", "*") and j + 1 < end and t.text[j + 1] not in (",", ":", "(", "}"):
                j += 1
            k = t.close(j, end) + 1 if t.text[j] == "[" else j + 1
            if k < end and t.text[k] in ("(", "<") and (t.kind[j] in "ws" or t.text[j] == "["):
                sig, b = self.signature(i, j, end)
                if b < end and t.text[b] == "{":
                    stop = t.close(b, end) + 1
                    self.add(i, stop, "Method", t.slice(j, k), parent, sig)
                    i = stop + 1
                    continue
            e = i
            while e < end and t.text[e] != ",":
                e = (t.close(e, end) if t.kind[e] == "p" and t.text[e] in "([{" else e) + 1
            self.search(i, e, parent)
            i = e + 1

    # classes

    def class_body(self, i: int, end: int, parent) -> None:
        while i < end:
            i = max(i + 1, self.class_member(i, end, parent))

    def class_member(self, i: int, end: int, parent) -> int:
        t = self.t
        notes, first = [], i
        while i < end and t.text[i] == "@" and i + 1 < end:
            j = self.decorator(i, end)
            notes.append(t.slice(i, j))
            i = j
        if i >= end or t.text[i] == ";":
            return i + 1
        begin = i
        while i + 1 < end and (t.text[i] in _MEMBER_WORDS and t.text[i + 1] not in ("(", "=", ";", ":", "<", "?", "!") or t.text[i] == "*"):
            if t.text[i] == "static" and t.text[i + 1] == "{":
                j = t.close(i + 1, end)
                self.statements(i + 2, j, parent)
                return j + 1
            i += 1
        k = t.close(i, end) + 1 if t.text[i] == "[" else i + 1
        name = t.slice(i, k)
        after = k + (k < end and t.text[k] in ("?", "!"))
        if after < end and t.text[after] in ("(", "<"):
            sig, b = self.signature(begin, i, end)
            if b < end and t.text[b] == "{":
                stop = t.close(b, end) + 1
                start = first if self.f.members else begin
                self.add(start, stop, "Method", name, parent, sig, notes[::-1])
                return stop
            return b + 1
        stop = self.ends(begin, end)
        last = stop - (t.text[stop - 1] == ";")
        if self.f.members and last > begin:
            content = t.slice(begin, last)
            self.add(begin, last, "Field", name, parent, content.strip().rstrip(";"), notes[::-1])
        return stop
