"""Blocks of SQL, YAML, JSON and other configuration files."""

from __future__ import annotations

import re

from codequarry.parsers.base import Parser, Symbol, base_name

# fixed values: words that begin a statement
STARTS = ("CREATE", "ALTER", "DROP", "INSERT", "UPDATE", "DELETE", "SELECT", "WITH", "GRANT", "REVOKE")
_OBJECT = r"(?:IF\s+(?:NOT\s+)?EXISTS\s+)?([\w.\"`\[\]]+)"
# fixed values: how a statement is called, first match first
_NAMES = (
    ("CREATE TABLE", rf"CREATE\s+(?:\w+\s+)*?TABLE\s+{_OBJECT}"),
    ("CREATE INDEX", rf"CREATE\s+(?:\w+\s+)*?INDEX\s+{_OBJECT}"),
    ("CREATE VIEW", rf"CREATE\s+(?:\w+\s+)*?VIEW\s+{_OBJECT}"),
    ("CREATE FUNCTION", rf"CREATE\s+(?:\w+\s+)*?(?:FUNCTION|PROCEDURE)\s+{_OBJECT}"),
    ("ALTER TABLE", rf"ALTER\s+TABLE\s+{_OBJECT}"),
    ("INSERT INTO", rf"INSERT\s+INTO\s+{_OBJECT}"),
)
_NAMED = tuple((label, re.compile(pattern, re.I)) for label, pattern in _NAMES)


class SqlParser(Parser):
    """Statements line by line: one begins at a line that starts with a statement word and ends at a line that ends with a
    semicolon. By default the words match as prefixes (`created_at` begins one); `strict` asks for whole words."""

    languages = ("sql",)

    def __init__(self, strict: bool = False):
        words = "|".join(STARTS)
        self.starts = re.compile(rf"(?:{words})\b" if strict else f"(?:{words})", re.I)

    def parse(self, text: str, path: str) -> list[Symbol]:
        out: list[Symbol] = []
        held: list[str] = []
        first, quote, comment = 1, "", False
        lines = text.split("\n")
        for number, line in enumerate(lines, 1):
            if not quote and not comment and held and self.starts.match(line.strip()):
                self._emit(held, first, number - 1, out)
                held, first = [], number
            held.append(line)
            quote, comment = self._state(line, quote, comment)
            if not quote and not comment and line.rstrip().endswith(";"):
                self._emit(held, first, number, out)
                held, first = [], number + 1
        self._emit(held, first, len(lines), out)
        return out

    @staticmethod
    def _state(line: str, quote: str, comment: bool) -> tuple[str, bool]:
        """Whether a string or a block comment is open after the line; line comments are read like any text."""
        k = 0
        while k < len(line):
            c = line[k]
            if comment:
                if line.startswith("*/", k):
                    comment, k = False, k + 1
            elif quote:
                if c == quote and line[k - 1 : k] != "\\":
                    quote = ""
            elif line.startswith("/*", k):
                comment, k = True, k + 1
            elif c in "'\"" and line[k - 1 : k] != "\\":
                quote = c
            k += 1
        return quote, comment

    def _emit(self, held: list[str], first: int, last: int, out: list[Symbol]) -> None:
        body = "\n".join(held).strip()
        if body:
            out.append(Symbol("block", self._name(body), first, last, body))

    def _name(self, body: str) -> str:
        for label, pattern in _NAMED:
            if m := pattern.search(body):
                return f"{label} {m[1]}"
        upper = body.upper()
        return next((f"SQL {w}" for w in STARTS if upper.startswith(w)), "SQL STATEMENT")


class ConfigParser(Parser):
    """One block per top-level key of a larger YAML map; any other file is one block."""

    languages = ("yaml", "json", "config")
    most_whole = 3  # a map of so many keys stays one block

    def parse(self, text: str, path: str) -> list[Symbol]:
        whole = [Symbol("block", base_name(path), 1, text.count("\n") + 1, text)]
        if not path.lower().endswith((".yaml", ".yml")):
            return whole
        import yaml

        try:
            node = yaml.compose(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        except yaml.YAMLError:
            return whole
        if not isinstance(node, yaml.MappingNode) or len(node.value) <= self.most_whole:
            return whole
        out = []
        for key, value in node.value:
            start, end = key.start_mark.index, max(value.end_mark.index, key.end_mark.index)
            body = text[start:end].strip()
            first = text.count("\n", 0, start) + 1
            out.append(Symbol("block", str(key.value), first, first + body.count("\n"), body))
        return out
