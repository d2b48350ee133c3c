"""Tokens of C-like languages: words, strings, marks, with the partner of every bracket."""

from __future__ import annotations

import re

_PAIRS = {"(": ")", "[": "]", "{": "}"}
_PLAIN = re.compile(r"[A-Za-z_$\u0080-\U0010ffff#][\w$\u0080-\U0010ffff]*|\d[\w.]*|=>|\.\.\.|\?\.|[=!]==?|[<>]=|&&|\|\||\?\?|\+\+|--|.", re.S)
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "=>", "??", "+", "return", "typeof", "case", "in", "of"}


class Tokens:
    """kind is 'w' (word or number), 's' (string, template or pattern) or 'p' (mark)."""

    def __init__(self, text: str, script: bool = False) -> None:
        self.source, self.text, self.kind = text, [], []
        self.start, self.end = [], []
        i, n = 0, len(text)
        while i < n:
            c = text[i]
            if c.isspace():
                i += 1
                continue
            if text.startswith("//", i):
                i = (text.find("\n", i) + n + 1) % (n + 1)
                continue
            if text.startswith("/*", i):
                j = text.find("*/", i + 2)
                i = n if j < 0 else j + 2
                continue
            if text.startswith('"""', i) and not script:
                j = text.find('"""', i + 3)
                j, kind = (n if j < 0 else j + 3), "s"
            elif c in "\"'" or c == "`" and script:
                j, kind = self._string(text, i, c), "s"
            elif c == "/" and script and (not self.text or self.text[-1] in _BEFORE_REGEX) and (j := self._pattern(text, i)):
                kind = "s"
            else:
                j = _PLAIN.match(text, i).end()
                kind = "w" if c.isalnum() or c in "_$#" or c >= "\u0080" else "p"
            self.text.append(text[i:j])
            self.kind.append(kind)
            self.start.append(i)
            self.end.append(j)
            i = j
        self.partner = self._partners()
        self.count = len(self.text)
        self.breaks = [0]
        for m in re.finditer("\n", text):
            self.breaks.append(m.end())

    @staticmethod
    def _string(text: str, i: int, quote: str) -> int:
        n, j = len(text), i + 1
        while j < n:
            if text[j] == "\\":
                j += 2
            elif quote == "`" and text.startswith("${", j):
                depth, j = 1, j + 2
                while j < n and depth:
                    if text[j] in "\"'`":
                        j = Tokens._string(text, j, text[j])
                        continue
                    depth += (text[j] == "{") - (text[j] == "}")
                    j += 1
            elif text[j] == quote:
                return j + 1
            elif text[j] == "\n" and quote != "`":
                return j
            else:
                j += 1
        return n

    @staticmethod
    def _pattern(text: str, i: int) -> int:
        j, inside = i + 1, False
        while j < len(text) and text[j] != "\n":
            if text[j] == "\\":
                j += 1
            elif text[j] == "[":
                inside = True
            elif text[j] == "]":
                inside = False
            elif text[j] == "/" and not inside:
                return re.compile(r"[a-z]*").match(text, j + 1).end()
            j += 1
        return 0

    def _partners(self) -> list[int]:
        out, stack = [-1] * len(self.text), []
        for i, t in enumerate(self.text):
            if self.kind[i] != "p":
                continue
            if t in _PAIRS:
                stack.append(i)
            elif t in ")]}":
                while stack and _PAIRS[self.text[stack[-1]]] != t:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    out[i], out[j] = j, i
        return out

    def close(self, i: int, end: int) -> int:
        """Index of the bracket that closes the one at i, or the end."""
        return self.partner[i] if self.partner[i] >= 0 else end - 1

    def angle(self, i: int, end: int) -> int:
        """Index after a <...> that opens at i."""
        depth = 0
        while i < end:
            t = self.text[i]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif t in "([{" and self.kind[i] == "p":
                i = self.close(i, end)
            elif t == ";":
                return i
            i += 1
        return end

    def line(self, offset: int) -> int:
        import bisect

        return bisect.bisect_right(self.breaks, offset)

    def slice(self, a: int, b: int) -> str:
        """Source of the tokens a to b, b excluded."""
        return self.source[self.start[a] : self.end[b - 1]] if b > a else ""

    def new_line(self, i: int) -> bool:
        """Whether token i is the first of its line."""
        return i == 0 or "\n" in self.source[self.end[i - 1] : self.start[i]]


def row(path, toks, a, b, language, kind, name, parent=None, signature=None, annotations=(), dependencies=(), offset=1) -> dict:
    """A block of the tokens a to b, b excluded; offset is the line number of the text's first line."""
    return {
        "file_path": path,
        "start_line": toks.line(toks.start[a]) + offset - 1,
        "end_line": toks.line(toks.end[b - 1]) + offset - 1,
        "content": toks.slice(a, b),
        "language": language,
        "kind": kind,
        "name": name,
        "parent": parent,
        "signature": signature,
        "annotations": list(annotations),
        "dependencies": list(dependencies),
    }
