"""Symbols of TypeScript, JavaScript and Java files, by a scanner that knows strings, comments and braces.

The scanner blanks what is no code (same length, line breaks kept), so that declarations can be found by patterns and
their ends by counting braces. It covers declarations at any depth; it does not build a syntax tree.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from codequarry.parsers.base import Parser, Symbol, first_seen

_NOT_CODE = re.compile(
    r"""/\*[\s\S]*?\*/|//[^\n]*|\"{3}[\s\S]*?\"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|(?<=[=(,:;!&|?\[])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"""
)
_NAME = r"[A-Za-z_$][\w$]*"


def blanked(text: str) -> str:
    """The text with comments, strings and regular expressions as spaces; quotes stay."""

    def blank(m: re.Match) -> str:
        word = m[0]
        inner = re.sub(r"[^\n]", " ", word)
        return word[0] + inner[1:-1] + word[-1] if word[0] in "\"'`" and len(word) > 1 else inner

    return _NOT_CODE.sub(blank, text)


def partners(code: str) -> dict[int, int]:
    """The position of each opening bracket's closing one; brackets left open end with the text."""
    out, stack = {}, []
    closes = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] in "([{":
            stack.append(m.start())
        elif stack and code[stack[-1]] == closes[m[0]]:
            out[stack.pop()] = m.start()
    for at in stack:
        out[at] = len(code) - 1
    return out


def comment_before(text: str, code: str, at: int) -> str | None:
    """The comment that stands between the previous code and the declaration at `at`."""
    end = len(code[:at].rstrip())
    gap = text[end:at].strip()
    found = re.findall(r"/\*[\s\S]*?\*/|(?://[^\n]*\n?[ \t]*)+", gap)
    return found[-1].rstrip() if found else None


def one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Braced(Parser):
    def _open(self, text: str) -> None:
        self.text, self.code = text, blanked(text)
        self.ends = partners(self.code)
        self.opened = sorted(s for s in self.ends if self.code[s] in "{(")
        # the bracket around each bracket, -1 at the top
        self.around, stack = {}, []
        for s in self.opened:
            while stack and self.ends[stack[-1]] < s:
                stack.pop()
            self.around[s] = stack[-1] if stack else -1
            stack.append(s)

    def _line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def _symbol(self, kind: str, name: str, start: int, end: int, signature: str | None, doc_at: int | None = None, **rest) -> Symbol:
        doc = comment_before(self.text, self.code, start if doc_at is None else doc_at)
        return Symbol(kind, name, self._line(start), self._line(max(start, end - 1)), self.text[start:end], signature, doc, **rest)

    def _parent(self, classes: list[tuple[int, int, str]], at: int) -> str | None:
        inside = [(s, n) for s, e, n in classes if s < at < e]
        return max(inside)[1] if inside else None

    def _member_of(self, classes: list[tuple[int, int, str]], at: int) -> str | None:
        """The class whose body directly holds the position."""
        k = bisect_left(self.opened, at) - 1
        innermost = self.opened[k] if k >= 0 else -1
        while innermost >= 0 and self.ends[innermost] < at:
            innermost = self.around[innermost]
        return next((n for s, _, n in classes if s == innermost), None)


_TS_TYPE = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:const\s+)?\b(class|interface|enum)\s+({_NAME})[^{{;]*\{{")
_TS_FUNCTION = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?\bfunction\s+({_NAME})\s*(?:<[^(]*>)?\s*\(")
_TS_ARROW = re.compile(rf"(?:export\s+)?\b(?:const|let|var)\s+({_NAME})\s*(?::[^=;]+)?=\s*(?:async\s+)?(?:\(|{_NAME}\s*=>|<)")
_TS_METHOD = re.compile(rf"(?:^|(?<=[;{{}}]))[ \t]*((?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?({_NAME})\s*(?:<[^(]*>)?\s*\()", re.M)
_WORDS = frozenset("if for while switch catch return function new await typeof super do else throw constructor".split()) - {"constructor"}


class TypeScriptParser(_Braced):
    languages = ("typescript", "javascript")

    def parse(self, text: str, path: str) -> list[Symbol]:
        self._open(text)
        code, ends, out, classes = self.code, self.ends, [], []
        for m in _TS_TYPE.finditer(code):
            brace, start = m.end() - 1, m.start(1)
            end = ends[brace] + 1
            if m[1] == "class":
                classes.append((brace, end, m[2]))
            if "abstract" in code[m.start() : start].split() and m[1] == "class":
                continue
            signature = None if m[1] == "enum" else one_line(text[start:brace])
            out.append((start, self._symbol(m[1], m[2], start, end, signature, m.start())))
        for m in _TS_FUNCTION.finditer(code):
            body = self._body(ends.get(m.end() - 1))
            if body:
                start = m.start() + len(m[0]) - len(re.sub(r"^(?:export\s+)?(?:default\s+)?", "", m[0]))
                out.append((start, self._symbol("function", m[1], start, ends[body] + 1, one_line(text[start:body]), m.start())))
        for m in _TS_ARROW.finditer(code):
            end = self._arrow_end(m)
            if end:
                start = m.start() + len(m[0]) - len(re.sub(r"^export\s+", "", m[0]))
                out.append((start, self._symbol("function", m[1], start, end, None, m.start())))
        for m in _TS_METHOD.finditer(code):
            if m[2] in _WORDS:
                continue
            parent = self._member_of(classes, m.start(1))
            body = self._body(ends.get(m.end() - 1)) if parent else None
            if body:
                out.append((m.start(1), self._symbol("method", m[2], m.start(1), ends[body] + 1, f"{parent}.{one_line(text[m.start(1):body])}", parent=parent)))
        return [s for _, s in sorted(out, key=lambda x: x[0])]

    def _body(self, closed: int | None) -> int | None:
        """The brace that opens the body after the parameter list that ends at `closed`."""
        if closed is None:
            return None
        m = re.compile(r"\s*(?::\s*(?:\{[^{}]*\})?[^{;=]*)?\{").match(self.code, closed + 1)
        return m.end() - 1 if m and (m.end() - 1) in self.ends else None

    def _arrow_end(self, m: re.Match) -> int | None:
        code, at = self.code, m.end() - 1
        if code[at] == "(":
            arrow = re.compile(r"\s*(?::[^=;]*)?=>\s*").match(code, self.ends[at] + 1)
        elif code[at] == "<":
            paren = code.find("(", at)
            arrow = re.compile(r"\s*(?::[^=;]*)?=>\s*").match(code, self.ends[paren] + 1) if paren >= 0 else None
        else:
            arrow = re.compile(r".*?=>\s*").match(code, m.end() - 2)
        if not arrow:
            return None
        at = arrow.end()
        if code[at : at + 1] == "{":
            end = self.ends[at] + 1
        else:
            depth, end = 0, at
            while end < len(code) and not (depth == 0 and code[end] in ";\n"):
                if code[end] in "([{":
                    end = self.ends[end]
                end += 1
        return end + 1 if code[end : end + 1] == ";" else end


_JAVA_MODS = r"(?:(?:public|private|protected|static|final|abstract|sealed|strictfp|synchronized|native|default|@\w+(?:\([^()]*\))?)\s+)*"
_JAVA_TYPE = re.compile(rf"({_JAVA_MODS})(?<!@)\b(class|interface|enum)\s+({_NAME})[^{{;]*\{{")
_JAVA_METHOD = re.compile(rf"(?:^|(?<=[;{{}}]))\s*({_JAVA_MODS}(?:<[^(;{{]*?>\s*)?(?:({_NAME}(?:\.{_NAME})*(?:<[^(;{{}}]*>)?(?:\[\])*)\s+)?({_NAME})\s*\()", re.M)
_JAVA_CALL = re.compile(rf"({_NAME})\s*\(")
_JAVA_NO_CALL = frozenset("if for while switch catch return new synchronized super this try".split())


class JavaParser(_Braced):
    languages = ("java",)

    def parse(self, text: str, path: str) -> list[Symbol]:
        self._open(text)
        code, ends, out, classes = self.code, self.ends, [], []
        package = re.search(r"^\s*package\s+([\w.]+)\s*;", code, re.M)
        package = package[1] if package else None
        imports = re.findall(r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;", code, re.M) or None
        for m in _JAVA_TYPE.finditer(code):
            brace = m.end() - 1
            end = ends[brace] + 1
            classes.append((brace, end, m[3]))
            signature = None if m[2] == "enum" else one_line(text[m.start() : brace])
            out.append((m.start(), self._symbol(m[2], m[3], m.start(), end, signature, package=package, imports=imports if m[2] == "class" else None)))
        for m in _JAVA_METHOD.finditer(code):
            if m[3] in _JAVA_NO_CALL or m[2] in ("return", "new", "throw", "else", "case"):
                continue
            parent = self._member_of(classes, m.start(1)) or (self._parent(classes, m.start(1)) if m[2] else None)
            closed = ends.get(m.end() - 1)
            if not parent or closed is None:
                continue
            after = re.compile(r"\s*(?:throws\s[^{;]*)?([{;])").match(code, closed + 1)
            if not after or (after[1] == ";" and not m[2]):
                continue
            body = after.end() - 1
            end = ends[body] + 1 if after[1] == "{" else after.end()
            start = m.start(1)
            signature = f"{parent}.{one_line(text[start:body])}"
            if m[2]:
                calls = first_seen(c for c in _JAVA_CALL.findall(code[body:end]) if c not in _JAVA_NO_CALL) or None
                out.append((start, self._symbol("method", m[3], start, end, signature, parent=parent, package=package, calls=calls)))
            elif m[3] == parent and after[1] == "{":
                out.append((start, self._symbol("method", f"{m[3]} (constructor)", start, end, signature, parent=parent, package=package)))
        return [s for _, s in sorted(out, key=lambda x: x[0])]
