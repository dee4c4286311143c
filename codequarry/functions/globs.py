"""Globs and ignore rules as regular expressions, for `rlike` on whole columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_regex(pattern: str) -> str:
    """`*` and `?` over a repository's name, anchored."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def path_regex(pattern: str) -> str:
    """A path glob: `**/` matches any number of directories, none included; `**` anything; `*` and `?` stay within a name;
    `{a,b}` alternatives."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif pattern[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif pattern[k] == "?":
            out, k = out + "[^/]", k + 1
        elif pattern[k] == "{" and "}" in pattern[k:]:
            end = pattern.index("}", k)
            out, k = out + "(?:" + "|".join(re.escape(x) for x in pattern[k + 1 : end].split(",")) + ")", end + 1
        else:
            out, k = out + re.escape(pattern[k]), k + 1
    return f"^{out}$"


# fixed values: the globs that stand for a rule of each kind, `{}` being the rule without its slash at either end
IGNORE_SHAPES = {
    "directory": ("**/{}/**", "{}/**"),
    "name": ("**/{}", "**/{}/**"),
    "rooted": ("{}", "{}/**"),
    "path": ("{}", "**/{}", "{}/**", "**/{}/**"),
}


def _rule_kind(rule: str) -> str:
    if rule[-1] == "/":
        return "directory"
    return "rooted" if rule[0] == "/" else "path" if "/" in rule else "name"


def ignore_globs(lines: Iterable[str]) -> list[str]:
    """The globs of a repository's ignore file. Comments, blank lines and negations are skipped."""
    rules = [rule for rule in map(str.strip, lines) if rule and rule[0] not in "#!"]
    trim = {"directory": lambda r: r[:-1], "rooted": lambda r: r[1:]}
    return [shape.format(trim.get(kind, str)(rule)) for rule in rules for kind in [_rule_kind(rule)] for shape in IGNORE_SHAPES[kind]]


def _any(column: Column, patterns: list[str]) -> Column:
    return column.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def matches_names(name: Column, include: Iterable[str], exclude: Iterable[str] = ()) -> Column:
    """Exclusion wins; a name that nothing includes is left out."""
    return F.coalesce(_any(name, [name_regex(p) for p in include]) & ~_any(name, [name_regex(p) for p in exclude]), F.lit(False))


def matches_paths(path: Column, include: Iterable[str], exclude: Iterable[str] = (), dot_files: bool = False) -> Column:
    """Included, not excluded, nowhere under `.git`, and no hidden file or directory unless asked for."""
    kept = _any(path, [path_regex(p) for p in include]) & ~_any(path, [path_regex(p) for p in [*exclude, "**/.git/**"]])
    return F.coalesce(kept if dot_files else kept & ~path.rlike(r"(?:^|/)\."), F.lit(False))


def is_ignored(path: Column, ignore_lines: Iterable[str]) -> Column:
    return F.coalesce(_any(path, [path_regex(g) for g in ignore_globs(ignore_lines)]), F.lit(False))
