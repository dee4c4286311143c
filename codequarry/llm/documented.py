"""Problem 4: functions and methods paired with their documentation.

`documented_functions` gives one row for each function or method of Python, TypeScript, JavaScript and Java files that is
really described: (file_id, symbol_name, name_line, signature, doc_comment, text).

How: a lexer that knows strings, template literals (with code nested in them to any depth), regular expressions and comments walks
each file once and notes which bracket closes which. What follows a documentation comment (or, in Python, each `def`) is matched as
a declaration, the noted brackets delimit header and body, however large, and the docstring or the comment that ends directly above the declaration, its decorators and
annotations is attached. Files that no grammar accepts (problem 1) are left out. Files are independent: one scan, no
shuffle but for repeated rows.

A description counts if at least five words are left without marks, lines that are tags (beginning with `@` or `:`), the word
"the" and words of the function's own name (also with an added s).

Defined cases: null contents or ids give no row; repeated rows of a file count once; very long files are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.syntax import EXTENSIONS, reason
from codequarry.session import spread

LEAST_WORDS = 5
LANGUAGES = ("python", "typescript", "javascript", "java")

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*+|//[/!]?|#+:?)?[ \t]*|[ \t]*\*+/[ \t]*$")


def description_lines(raw: str) -> list[str]:
    """The lines of a comment or docstring without their marks."""
    return [_MARKS.sub("", _MARKS.sub("", line, count=1)).strip() for line in raw.splitlines()]


def words_left(raw: str, name: str) -> int:
    own = {p.lower() for p in _NAME_PART.findall(name)}
    own |= {p + "s" for p in own} | {"the", name.lower()}
    return sum(w.lower() not in own for line in description_lines(raw) if line[:1] not in ("@", ":") for w in _WORD.findall(line))


def described(raw: str, name: str) -> bool:
    return words_left(raw, name) >= LEAST_WORDS


# --- languages with braces ------------------------------------------------------------------------------------------
_LITERAL = r""""(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'"""
_REGEX = r"(?<=[=(,:;!&|?+\[])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/"
_BLOCK = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_SIGNS = r"(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<mark>[;,])"
_SCRIPT_LEX = re.compile(rf"(?P<block>{_BLOCK})|(?P<line>//[^\n]*)|{_LITERAL}|(?P<tick>`)|{_REGEX}|{_SIGNS}")
_JAVA_LEX = re.compile(rf'(?P<block>{_BLOCK})|(?P<line>//[^\n]*)|"""[^\\"]*(?:(?:\\[\s\S]|"(?!""))[^\\"]*)*"""|{_LITERAL}|{_SIGNS}')
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")


class Signs:
    """What one walk over a file finds: its comments, which bracket closes which, and the commas and semicolons between."""

    def __init__(self, text: str, lexer: re.Pattern):
        self.text = text
        self.comments: list[tuple[int, int, bool]] = []  # start, end, a line comment?
        self.closes: dict[int, int] = {}  # an opening bracket's position to the one behind its closing bracket
        self.opens: dict[int, int] = {}  # a closing bracket's position to that of its opening one
        self.places: list[int] = []  # of brackets, commas and semicolons
        stack: list[int] = []
        pos = 0
        while m := lexer.search(text, pos):
            kind, start, pos = m.lastgroup, m.start(), m.end()
            if kind == "open":
                stack.append(start)
                self.places.append(start)
            elif kind == "close":
                if stack and stack[-1] < 0:  # the end of code in a template literal
                    stack.pop()
                    pos = self._template(pos, stack)
                    continue
                self.places.append(start)
                if stack:
                    opened = stack.pop()
                    self.closes[opened], self.opens[start] = pos, opened
            elif kind == "mark":
                self.places.append(start)
            elif kind == "tick":
                pos = self._template(pos, stack)
            elif kind:
                self.comments.append((start, pos, kind == "line"))

    def _template(self, pos: int, stack: list[int]) -> int:
        """The position where a template literal that goes on at pos ends, or code in it begins."""
        end = _TEMPLATE.match(self.text, pos).end()
        if self.text.startswith("${", end):
            stack.append(-1)
            return end + 2
        return end + 1

    def closing(self, pos: int) -> int:
        """The position behind the bracket that closes the one at pos, or -1."""
        return self.closes.get(pos, -1)

    def end_of_expression(self, pos: int) -> int:
        """The first comma, semicolon or closing bracket from pos on that isn't inside brackets."""
        k = bisect_left(self.places, pos)
        while k < len(self.places):
            at = self.places[k]
            closed = self.closes.get(at)
            if closed is None:
                return at
            k = bisect_left(self.places, closed, k)
        return len(self.text)


_ID = r"[A-Za-z_$\u0080-￿][\w$]*"
_GAP = rf"(?:\s|{_BLOCK}|//[^\n]*\n)*"
_DECORATOR = re.compile(rf"[ \t]*@(?!interface\b){_ID}(?:\s*\.\s*{_ID})*[ \t]*(\()?")
_FUNCTION = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*({_ID})\s*(?=[<(])")
_ARROW = re.compile(rf"(?:export\s+)?(?:declare\s+)?const\s+({_ID})\s*(?::[^=;]*?(?:=>[^=;]*?)?)?=(?![=>])\s*(?:async\b\s*)?(?=[(<]|{_ID}\s*=>|function\b)")
_METHOD = re.compile(rf"(?:(?:public|private|protected|static|abstract|override|readonly|async|get|set|declare)\s+(?![(<=:;]))*\*?\s*(#?{_ID})\s*(?=[<(])")
_NOT_METHODS = frozenset("if for while switch catch return throw new else do try with function typeof await yield super import delete void case in of instanceof".split())
_JAVA_METHOD = re.compile(
    rf"(?:(?:public|private|protected|static|abstract|final|native|synchronized|default|strictfp)\s+)*(?:<[^;{{}}()]*?>\s*)?(?:(?:@{_ID}(?:\([^()]*\))?\s+)*{_ID}(?:\s*\.\s*{_ID})*(?:\s*<[^;{{}}()]*?>)?(?:\s*\.\s*{_ID}(?:\s*<[^;{{}}()]*?>)?)*(?:\s*\[\s*\])*\s+)?({_ID})\s*(?=\()"
)
_JAVA_NOT = re.compile(r"(?:return|throw|new|else|case|yield|assert|do|try|if|for|while|switch|catch|synchronized\s*\(|super|this)\b")


_ANGLE = re.compile(r"=>|[<>;(\[{)\]}]")


def _angles(text: str, pos: int, signs: Signs) -> int:
    """The position after type parameters that begin at pos; brackets in them are passed whole."""
    depth = 0
    while m := _ANGLE.search(text, pos):
        sign, pos = m[0], m.end()
        if sign == "<":
            depth += 1
        elif sign == ">":
            depth -= 1
            if not depth:
                return pos
        elif sign != "=>":
            pos = signs.closing(m.start())
            if pos < 0:
                return -1
    return -1


_AFTER_HEADER = re.compile(r"\s*(?::(?P<type>[^;{}]*?(?:\{[^{}]*\}[^;{}]*?)?))?\s*(?P<end>\{|;|(?=\n))")
_AFTER_ARROW = re.compile(r"\s*(?::[^;]*?)?=>\s*")
_AFTER_JAVA = re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws\s[^;{}]*)?(?:default\s[^;]*)?(\{|;)")


def _script_declaration(text: str, pos: int, signs: Signs):
    """(name, its position, end of signature, end of text) of a declaration that begins at pos."""
    arrow = False
    if m := _FUNCTION.match(text, pos):
        method = False
    elif m := _ARROW.match(text, pos):
        method, arrow = False, True
    elif m := _METHOD.match(text, pos):
        method = True
        if m[1] in _NOT_METHODS or text.startswith("new", pos):
            return None
    else:
        return None
    at = m.end()
    if arrow and not text.startswith(("(", "<", "function"), at):
        at = text.index("=>", at) + 2
        return (m[1], m.start(1), at, _body_end(text, at, signs))
    if arrow and text.startswith("function", at) and not text[at + 8 : at + 9].isalnum():
        at = text.find("(", at)
        method = True
    if text.startswith("<", at):
        at = _angles(text, at, signs)
        if at < 0:
            return None
        at = re.compile(r"\s*").match(text, at).end()
    if not text.startswith("(", at):
        return None
    closed = signs.closing(at)
    if closed < 0:
        return None
    if arrow and not method:
        after = _AFTER_ARROW.match(text, closed)
        if not after:
            return None
        return (m[1], m.start(1), after.end(), _body_end(text, after.end(), signs))
    after = _AFTER_HEADER.match(text, closed)
    if not after:
        return None
    if after["end"] == "{":
        return (m[1], m.start(1), after.end() - 1, signs.closing(after.end() - 1))
    # without a body: an overload, an abstract method or an interface's; a call has neither type nor modifier
    bodiless = text.startswith(("abstract", "declare", "export", "function", "public", "private", "protected"), pos) or after["type"]
    return (m[1], m.start(1), after.end(), after.end()) if bodiless else None


def _body_end(text: str, at: int, signs: Signs) -> int:
    """The end of an arrow function's body."""
    at = re.compile(r"\s*").match(text, at).end()
    return signs.closing(at) if text.startswith("{", at) else signs.end_of_expression(at)


def _java_declaration(text: str, pos: int, signs: Signs):
    if _JAVA_NOT.match(text, pos):
        return None
    m = _JAVA_METHOD.match(text, pos)
    if not m or m[1] in _NOT_METHODS:
        return None
    closed = signs.closing(m.end())
    if closed < 0:
        return None
    after = _AFTER_JAVA.match(text, closed)
    if not after:
        return None
    if after[1] == "{":
        return (m[1], m.start(1), after.end() - 1, signs.closing(after.end() - 1))
    typed = re.search(r"\s", text[pos : m.start(1)].strip() + " ") and text[pos : m.start(1)].strip()
    return (m[1], m.start(1), after.end(), after.end()) if typed else None


def braced_functions(text: str, java: bool) -> Iterator[tuple[str, int, str, str, str]]:
    """(name, position, signature, documentation, text) of every described function."""
    signs = Signs(text, _JAVA_LEX if java else _SCRIPT_LEX)
    run: tuple[int, int] | None = None  # consecutive line comments
    comments: list[tuple[int, int]] = []
    for start, end, line in signs.comments:
        begin = text.rfind("\n", 0, start) + 1
        if text[begin:start].strip():
            run = None
            continue  # behind code
        if line:
            if run and not text[run[1] : start].strip() and text.count("\n", run[1], start) == 1:
                run = (run[0], end)
                comments[-1] = run
            else:
                run = (start, end)
                comments.append(run)
        else:
            run = None
            comments.append((start, end))
    for start, end in comments:
        stop = text.find("\n", end)
        if stop < 0 or text[end:stop].strip():
            continue
        pos = stop + 1
        while d := _DECORATOR.match(text, pos):
            close = signs.closing(d.end() - 1) if d[1] else d.end()
            if close < 0:
                break
            pos = close
            gap = re.compile(r"[ \t\r]*\n?").match(text, pos)
            pos = gap.end()
        pos = re.compile(r"[ \t]*").match(text, pos).end()
        found = (_java_declaration if java else _script_declaration)(text, pos, signs)
        if found and described(text[start:end], found[0]):
            name, at, signed, close = found
            yield name, at, text[pos:signed].strip(), text[start:end], text[pos : close if close > 0 else len(text)]


# --- Python -----------------------------------------------------------------------------------------------------------
_PY_STRING = r"""[rRbBuUfFtT]{0,2}(?:\"{3}[^\\"]*(?:(?:\\[\s\S]|"(?!""))[^\\"]*)*\"{3}|'{3}[^\\']*(?:(?:\\[\s\S]|'(?!''))[^\\']*)*'{3}|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')"""
_PY_LEX = re.compile(rf"^([ \t]*)((?:async[ \t]+)?def[ \t]+(\w+))|\#[^\n]*|{_PY_STRING}", re.M)
_PY_BRACKETS = re.compile(rf"{_PY_STRING}|\#[^\n]*|([(\[{{])|([)\]}}])|(:)|(\n)")
_PY_SIGNS = re.compile(rf"{_PY_STRING}|\#[^\n]*|{_SIGNS}")
_PY_LITERAL = re.compile(_PY_STRING)
_PY_END = re.compile(r"[ \t]*(?:\#[^\n]*)?(?:\n|;|$)")
_QUOTES = re.compile(r"^[rRuU]?(\"{3}|'{3}|\"|')([\s\S]*)\1$")


def _python_docstring(text: str, pos: int) -> str | None:
    """The docstring that begins a body after its colon at pos."""
    at = re.compile(r"(?:[ \t]*(?:\#[^\n]*)?\n)*[ \t]*").match(text, pos).end()
    m = _PY_LITERAL.match(text, at)
    if not m or m[0][0] in "bBfFtT" or not _PY_END.match(text, m.end()):
        return None
    body = _QUOTES.match(m[0])
    return body[2] if body else None


def _python_comment_above(text: str, pos: int, signs: Callable[[], Signs]) -> str | None:
    """The comment lines directly above the declaration whose first line begins at pos, its decorators skipped."""
    lines: list[str] = []
    above = pos
    while above > 0:
        start = text.rfind("\n", 0, above - 1) + 1
        line = text[start : above - 1].strip()
        if line.startswith("#"):
            lines.append(line)
        elif lines or not line:
            break
        elif line.startswith("@"):
            pass
        elif line[-1:] in ")]}" and (at := _decorator_start(text, above - 1, signs())) >= 0:
            start = at
        else:
            break
        above = start
    return "\n".join(reversed(lines)) if lines else None


def _decorator_start(text: str, end: int, signs: Signs) -> int:
    """Where the line of a decorator over several lines begins whose last bracket closes before `end`, or -1."""
    last = len(text[:end].rstrip()) - 1 if text[end - 1 : end].isspace() else end - 1
    opened = signs.opens.get(last, -1)
    if opened < 0:
        return -1
    begin = text.rfind("\n", 0, opened) + 1
    return begin if text[begin:opened].lstrip().startswith("@") else -1


def _python_end(text: str, pos: int, indent: str) -> int:
    """The end of the suite after the header's colon at pos."""
    line_end = text.find("\n", pos)
    if line_end < 0:
        return len(text)
    if text[pos:line_end].split("#")[0].strip():
        return line_end
    end = line_end
    inside_until = -1
    for m in re.compile(rf"{_PY_STRING}|\#[^\n]*|^(?=([ \t]*)\S)", re.M).finditer(text, line_end + 1):
        if m[1] is None:
            inside_until = m.end()
            continue
        if m.start() < inside_until:
            continue
        if len(m[1].expandtabs()) <= len(indent.expandtabs()) and not text[m.end(1)] in ")]}#":
            break
        stop = text.find("\n", m.start())
        end = stop if stop >= 0 else len(text)
    return max(end, inside_until if inside_until > end else end)


def python_functions(text: str) -> Iterator[tuple[str, int, str, str, str]]:
    signs = lru_cache(1)(lambda: Signs(text, _PY_SIGNS))
    for m in _PY_LEX.finditer(text):
        if m[3] is None:
            continue
        name, depth, colon = m[3], 0, -1
        for b in _PY_BRACKETS.finditer(text, m.end()):
            if b[1]:
                depth += 1
            elif b[2]:
                depth -= 1
            elif b[3] and not depth:
                colon = b.end()
                break
        if colon < 0:
            continue
        doc = _python_docstring(text, colon) or _python_comment_above(text, m.start(), signs)
        if doc and described(doc, name):
            start = m.start(2)
            yield name, m.start(3), text[start:colon].strip(), doc, text[start : _python_end(text, colon, m[1])]


def functions_of(text: str, language: str) -> Iterator[tuple[str, int, str, str, str]]:
    """(name, line, signature, documentation, text) of every described function; lines counted by LF from 1."""
    text = text.replace("\r\n", "\n")
    found = python_functions(text) if language == "python" else braced_functions(text, language == "java")
    for name, at, *rest in found:
        yield name, text.count("\n", 0, at) + 1, *rest


_COLUMNS = ["file_id", "symbol_name", "name_line", "signature", "doc_comment", "text"]


def _paired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, extension, content) to the rows of `documented_functions`."""
    for batch in batches:
        rows: list[tuple] = []
        for k, (extension, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            language = EXTENSIONS.get(extension.lower())
            found = list(functions_of(text, language))
            if found and reason(text, language) is None:
                rows += [(k, *f) for f in found]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]], _COLUMNS)


def _own(files: DataFrame) -> DataFrame:
    listed = [e for e, language in EXTENSIONS.items() if language in LANGUAGES]
    return files.where("file_id is not null and content is not null").where(F.lower("extension").isin(*listed)).select("file_id", "extension", "content")


def documented_functions(files: DataFrame) -> DataFrame:
    """One row per described function or method."""
    own = _own(files)
    kind = own.schema["file_id"].dataType.simpleString()
    rows = spread(own).mapInArrow(_paired, f"file_id {kind}, symbol_name string, name_line int, signature string, doc_comment string, text string")
    return rows.dropDuplicates(["file_id", "symbol_name", "name_line"])


def described_names(files: DataFrame) -> DataFrame:
    """(file_id, symbol_name, name_line) of the same rows, without their texts."""
    own = _own(files)
    kind = own.schema["file_id"].dataType.simpleString()
    return spread(own).mapInArrow(lambda b: (x.select([0, 1, 2]) for x in _paired(b)), f"file_id {kind}, symbol_name string, name_line int").distinct()
