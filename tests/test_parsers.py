import pytest

from codequarry.operators.chunking import chunk_rows, default_parsers, split, symbols_of
from codequarry.parsers.base import Symbol
from codequarry.parsers.braces import JavaParser, TypeScriptParser
from codequarry.parsers.plain import ConfigParser, SqlParser
from codequarry.parsers.python import PythonParser

TS = """/** Counts. */
export class Counter {
  private n = 0;
  constructor(start: number) {
    this.n = start;
  }
  // adds one; "quoted" { brace
  add(by: number): Counter {
    const s = "}";
    return this;
  }
}

/** Makes one. */
export function make(v = 0): Counter {
  return new Counter(v);
}
export interface Shape { name: string; }
export enum Kind { A = "a" }
const twice = (x: number): number => x * 2;
"""

JAVA = """package a.b;
import java.util.List;
/** Doc. */
public class Calc extends Base {
    private int v;
    public Calc(int v) { this.v = v; }
    /* Adds. */
    @Override
    public int add(int n) throws X { list.add(n); helper(n); return v; }
    enum K { A, B }
}
"""

PY = '''import os, sys as s
from typing import List
class C(Base):
    """Doc."""
    def _hidden(self): pass
    def __init__(self, x): self.x = foo(x)
    def add(self, n: float) -> "C":
        return self.bar.baz(n)
async def top(a, *b): return C(a)
'''


def shape(symbols):
    return [(s.type, s.name, s.start_line, s.end_line, s.parent) for s in symbols]


def test_typescript_symbols():
    found = TypeScriptParser().parse(TS, "a.ts")
    assert shape(found) == [
        ("class", "Counter", 2, 12, None), ("method", "constructor", 4, 6, "Counter"), ("method", "add", 8, 11, "Counter"), ("function", "make", 15, 17, None),
        ("interface", "Shape", 18, 18, None), ("enum", "Kind", 19, 19, None), ("function", "twice", 20, 20, None),
    ]
    assert found[0].doc_comment == "/** Counts. */" and found[3].doc_comment == "/** Makes one. */"
    assert found[2].signature == "Counter.add(by: number): Counter"


def test_java_symbols():
    found = JavaParser().parse(JAVA, "A.java")
    assert shape(found) == [("class", "Calc", 4, 11, None), ("method", "Calc (constructor)", 6, 6, "Calc"), ("method", "add", 8, 9, "Calc"), ("enum", "K", 10, 10, None)]
    assert found[0].package == "a.b" and found[0].imports == ["java.util.List"] and found[2].calls == ["add", "helper"]


def test_python_symbols():
    found = PythonParser().parse(PY, "a.py")
    assert shape(found) == [("class", "C", 3, 8, None), ("method", "__init__", 6, 6, "C"), ("method", "add", 7, 8, "C"), ("function", "top", 9, 9, None)]
    assert found[0].doc_comment == '"""Doc."""' and found[0].imports == ["os", "typing"] and found[2].calls == ["baz"]
    assert found[2].signature == 'C.def add (self, n: float) -> "C":'


def test_broken_python_becomes_one_file_chunk():
    found = symbols_of("def f(:\n", "x/a.py", "python", default_parsers())
    assert shape(found) == [("file", "a.py", 1, 2, None)]


def test_file_without_declarations_has_no_symbols():
    assert symbols_of("x = 1\n", "a.py", "python", default_parsers()) == []


SQL = """-- Create users table
CREATE TABLE users (
  id INT PRIMARY KEY,
  name TEXT,
  mail TEXT,
  created_at TIMESTAMP
);
INSERT INTO users VALUES (1, 'it''s; fine');"""


def test_sql_statements():
    assert [(s.name, s.start_line, s.end_line) for s in SqlParser().parse(SQL, "a.sql")] == [
        ("SQL STATEMENT", 1, 1), ("CREATE TABLE users", 2, 5), ("SQL CREATE", 6, 7), ("INSERT INTO users", 8, 8),
    ]
    assert [s.name for s in SqlParser(strict=True).parse(SQL, "a.sql")] == ["SQL STATEMENT", "CREATE TABLE users", "INSERT INTO users"]
    assert SqlParser().parse("  \n \n", "a.sql") == []


def test_config_blocks():
    yaml = "a: 1\nb:\n  c: 2\nd: [1,\n  2]\ne: x\n"
    assert [(s.name, s.start_line, s.end_line) for s in ConfigParser().parse(yaml, "x.yaml")] == [("a", 1, 1), ("b", 2, 3), ("d", 4, 5), ("e", 6, 6)]
    assert len(ConfigParser().parse("a: 1\nb: 2\n", "x.yml")) == 1
    assert len(ConfigParser().parse("a: [1\nb: }\n", "x.yml")) == 1
    assert ConfigParser().parse("[1, 2]", "p/package.json")[0].name == "package.json"


def spans(text, tokens, overlap):
    return [(a, b) for _, a, b in split(text, 1, text.count("\n") + 1, tokens, overlap)]


def test_oversize_lines_plateau_at_the_overlap():
    text = "\n".join(["x" * 500] * 9)
    assert spans(text, 25, 100) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 7), (3, 8), (4, 9)]


def test_split_without_overlap_covers_every_line_once():
    text = "\n".join("line %d" % k for k in range(100))
    parts = spans(text, 20, 0)
    assert [a for a, _ in parts] == [1] + [b + 1 for _, b in parts[:-1]] and parts[-1][1] == 100


def test_doc_comment_and_header():
    short = Symbol("method", "m", 1, 1, "m() {}", doc_comment="// d", parent="C")
    assert chunk_rows(short, 100, 10) == [("m", 1, 1, "// d\nm() {}")]
    long = Symbol("method", "m", 5, 54, "\n".join(["y" * 30] * 50), doc_comment="// d", parent="C")
    rows = chunk_rows(long, 100, 10)
    assert len(rows) > 1 and all(r[3].startswith("// In class: C\n") for r in rows) and rows[0][0] == "m (part 1)" and rows[-1][2] == 54


@pytest.mark.parametrize("seed", range(40))
def test_split_rules_on_random_texts(seed):
    import random

    r = random.Random(seed)
    lines = ["z" * r.randint(0, 60) for _ in range(r.randint(1, 60))]
    tokens, overlap = r.randint(5, 40), r.choice([0, 10, 20, 40])
    parts = split("\n".join(lines), 1, len(lines), tokens, overlap)
    keep = -(-overlap * 4 // 80)
    assert parts[0][1] == 1 and parts[-1][2] == len(lines)
    for (text, a, b), following in zip(parts, parts[1:] + [None]):
        assert text == "\n".join(lines[a - 1 : b])
        if following:
            assert following[1] <= b + 1
        assert len(text) <= tokens * 4 or b - a <= keep
