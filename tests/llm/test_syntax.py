import ast
import json
import random
import sysconfig
import tomllib
import warnings
from concurrent.futures import ProcessPoolExecutor
from multiprocessing import get_context
from pathlib import Path

import pytest

from codequarry.llm import syntax as S
from codequarry.llm.gll import Grammar

VALID = {
    "python": ["x = 1\n", "def f(a, *b, c=1, **d) -> int:\n    return a if b else c\n", "@d\nclass A(B, m=1):\n    '''doc'''\n    x: int = 0\n\n    async def g(self):\n        async with a as b, c:\n            yield [i async for i in b if i]\n", "match x:\n    case {'a': [1, *r], **k} if r: pass\n    case A(b=1) | None: pass\n", "try:\n    pass\nexcept* E as e:\n    raise\nelse:\n    pass\nfinally:\n    del a, b[0]\n", "f = lambda *a, b=2: {**a, 'x': f'{b!r:>{a}}'}\na, *b = c = 1, 2\nprint(*a, sep='')\n", "if x: pass\nelif y: z = 1\nelse: w()\n", "x[1:2, ::3] = y[...]\nwith (open(a) as f, open(b) as g,):\n    pass\n", "\\\n\n# c\n", "type A[T] = list[T]\ndef f[T: int](x: T): ...\n", "for i, in x: break\nelse: pass\n"],
    "javascript": ["import a, { b as c } from 'm';\nexport default class { #p = 1; get x() { return this.#p } static async *g() {} }\n", "const {a = 1, ...r} = x, [b,, c] = y\nlet f = async ({p}) => ({p}), g = x => x\n", "if (a) b(); else c()\nfor (const x of y) for (;;) break\nlabel: while (1) continue label\n", "x = /[/\"']+/g.test(s) ? `a${`b${c}`}` : d?.e?.[f] ?? g\n", "switch (a) { case 1: case 2: { b() } break; default: c() }\ntry { a() } catch { b() } finally { c() }\n", "var a = function* () { yield* b }, o = { get a() { return 1 }, ['k' + 1]: 2, async *m() {}, f, 'x': 3, }\n", "!function(e,t){'use strict';t.x=function(c){for(var r=0;r<5;r++)c.y(r)}}(this,{})", "a\n++b\nreturn_ = 1\n", "do x++; while (x < 5) y()\n"],
    "typescript": ["export abstract class A<T extends B = C> extends D<T> implements E, F { private readonly x?: Map<string, number[]> = new Map<string, number[]>(); constructor(private a: string, b?: number) { super() } abstract m(): void; static #q<T>(this: A, ...r: T[]): r is T[] { return true } [k: string]: unknown }\n", "type X = { readonly [K in keyof T]?: T[K] } & (A | B)[] | ((a: string) => void) | `a${string}`;\ninterface I<T> extends J<T> { (a: T): void; new (x: T): I<T>; m?<U>(u: U): U; readonly p: string, }\n", "enum E { A = 1, B = A << 2 }\ndeclare module 'x' { export function f(a: any): asserts a is string; }\nnamespace N.M { export const a = 1 }\n", "let x = y as unknown as Z[], w = <T,>(a: T): a is T => a!, v = f<string>(x) satisfies V;\nimport type { T } from './t'\nexport type { T }\n", "function f(a: string): void;\nfunction f(a: any) { for (const k in a) {} }\n", "const m = async (a: Record<string, number>, b: string[]): Promise<void> => { await g(a.b?.c); };"],
    "java": ["package a.b;\nimport static java.util.List.*;\n@A(x = 1, y = {B.class, C.class}) public final class D<T extends E & F<? super T>> extends G<T[]> implements H { private int a = 1, b[] = {1, 2}; static { f(); } public D(final int... x) throws I { this.a = (int) (long) x[0]; } <U> U m(Map<String, List<U>> z) { return z.get(\"\"\"\n  t\"\"\").stream().map(q -> q::<U>r).toList().get(0); } }\n", "enum A { B(1) { void f() {} }, C; A(int... x) {} }\nrecord R(int a, @N String b) { R { if (a < 0) throw new X(); } }\ninterface I { default void f() {} int g(); int K = 1 >> 2 >>> 3; }\n", "class A { void f() { for (var x : y) { switch (x) { case B b when b.c() -> d(); default -> { } } } int i = switch (j) { case 1, 2: yield 3; default: yield 4; }; try (var r = g(); s) { } catch (E | F e) { } finally { } if (o instanceof P(var q, int w)) a: do i++; while (i < 3); Runnable z = () -> {}; new int[3][]; }}".replace("new int[3][]; ", "Object u = new int[3][]; ")],
    "sql": ["SELECT a.b, COUNT(*) AS n FROM t a LEFT JOIN u USING (id) WHERE x IN (SELECT y FROM z) AND w BETWEEN 1 AND 2 OR NOT EXISTS (SELECT 1) GROUP BY a.b HAVING COUNT(*) > 1 ORDER BY n DESC NULLS LAST LIMIT 5;\nwith c as (select 1 union all select 2) select sum(x) over (partition by y order by z rows between 1 preceding and current row) from c", "CREATE TABLE IF NOT EXISTS s.t (id BIGSERIAL PRIMARY KEY, a NUMERIC(10, 2) NOT NULL DEFAULT 0, b TIMESTAMP WITH TIME ZONE DEFAULT now(), FOREIGN KEY (a) REFERENCES u (id) ON DELETE CASCADE, CHECK (a > 0));\nCREATE UNIQUE INDEX i ON t (lower(a), b DESC) WHERE a > 1;\nINSERT INTO t (a, b) VALUES (1, 'it''s'), (2, NULL) ON CONFLICT (a) DO UPDATE SET b = EXCLUDED.b RETURNING *;", "UPDATE t SET a = CASE WHEN b = 1 THEN 'x' ELSE c || 'y' END, d = NULL WHERE e ->> 'f' = '1';\nDELETE FROM t WHERE a <> 1; ALTER TABLE t ADD COLUMN z TEXT; DROP VIEW IF EXISTS v; GRANT SELECT, INSERT ON t TO r;\n-- c\n/* d */ CREATE OR REPLACE FUNCTION f(a int) RETURNS int AS $$ BEGIN RETURN 1; END; $$ LANGUAGE plpgsql;"],
    "yaml": ["a: 1\nb:\n- x\n- y: 2\n  z: [1, {q: r}]\nc: |\n  text: no\n   more\nd: 'it''s'\ne: \"a\\\"b\"\n", "# c\n---\n- - 1\n  - 2\n-\n  k: &x v\n- *x\n", "key: plain text\n  goes on\nurl: http://a.b:80/c\nempty:\nlast: >-\n  folded\n", "{a: 1, \"b\": [2]}\n", ""],
    "json": ['{"a": [1, -2.5e3, "x\\u00e9", true, null, {}], "b": {}}', "[]", '"s"'],
    "toml": ['a = 1\n[b.c]\nd = "x" # c\ne = [1, 2,\n 3]\nf = {g = 1, "h" = 2}\n[[i]]\nj = 1979-05-27T07:32:00Z\nk.l = \'\'\'m\'\'\'\n'],
    "ini": ["; c\n[s]\na = 1\nb: 2\nc =\n"],
}

BROKEN = {
    "python": ["def f(:\n    pass\n", "x = (1\n", "if x:\npass\n", "print 'a'\n", "a = 1 +\n", "try:\n    pass\nx = 1\n", "x = 'a\n", "  x = 1\ny = 2\n", "f() = 1\n", "<<<<<<< HEAD\nx = 1\n=======\n", "x = 01\n", "12ab\n", "class A\n    pass\n", "f'{a'\n", "else:\n    pass\n", "f(a=1, b)\n", "def f(a=1, b): pass\n", "function f() { return 1; }\n"],
    "javascript": ["function f( {", "let x = ;", "const a: string = 1;", "if (a { b() }", "<<<<<<< a\nx()\n=======\ny()\n>>>>>>> b\n", "class A { x() { } ", "a b c", "x = 'a\n';", "def f(): pass", "for (const a of b", "return }", "x = `${}`", "a > > b", "interface A { b: string }"],
    "typescript": ["type A = ;", "let a: = 1", "class A { private }}", "function f(a: string { }", "public class B { int x; }", "SELECT 1 FROM x;", "enum E { A B }"],
    "java": ["class A { void f() { int = 1; } }", "class A { void f() { x + 1; } }", "class A { void f() { a.b; } }", "class A { void f() { (a, b); } }", "class A {", "public void f() {}}", "class A { int f() { return 1 } }", "import a.b\nclass C {}", "function f() {}"],
    "sql": ["SELECT FROM t;", "CREATE TABLE t (", "INSERT INTO t (a, b VALUES (1, 2);", "SELECT a FROM t WHERE;", "UPDATE t a = 1;", "SELECT 'a FROM t;", "const x = 1;", "SELECT a, FROM t;"],
    "yaml": ["a: 1\n\tb: 2\n", "a: b: c\n", "{a: {b: 1 c: 2}}\n", '{"a": "b" "c": 1}\n', "a: -\n", "a: 'x\n", "a: [1, 2\n", "a: 1\nb\nc: 2\n", "a: 1\n  b: 2\n", "a: @x\n", "<<<<<<< HEAD\na: 1\n=======\n", "{a: 1\n", "a:\n    b: 1\n  c: 2\n"],
    "json": ['{"a": 1,}', "{'a': 1}", '{"a": 1', "[1 2]", '{"a": 01}', "{a: 1}", "// c\n{}", '{"a": "x\n"}'],
    "toml": ["a = \n", "[a\n", 'a = "x\n', "a 1\n", "a = 1 2\n", "<<<<<<< a\n"],
    "ini": ["[a\nb = 1\n", "just words\n", "<<<<<<< HEAD\na = 1\n"],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert S.reason(text, language) is None
    assert S.reason(text.replace("\n", "\r\n"), language) is None


@pytest.mark.parametrize("language, text", [(k, t) for k, v in BROKEN.items() for t in v])
def test_broken(language, text):
    assert S.reason(text, language) is not None


def test_mutations_agree_with_the_languages_own_parsers():
    r = random.Random(4)
    own = {"python": ast.parse, "json": json.loads, "toml": tomllib.loads}
    wrong = total = 0
    for language, parse in own.items():
        for base in VALID[language] * (6 if language == "python" else 25):
            k = r.randrange(len(base) + 1)
            text = base[:k] + r.choice(["", "", "(", ")", ":", "\n", " ", "x", ",", "=", "'"]) + base[k + r.choice([0, 1, 3]) :]
            try:
                parse(text)
                ok = True
            except Exception:
                ok = False
            if text.strip():
                total += 1
                wrong += ok != (S.reason(text, language) is None)
    assert wrong <= 0.03 * total


def test_gll_handles_ambiguity_and_left_recursion():
    h = Grammar("E = E '+' E | E '*' E | NUM\nS = S S | 'a' |\nL = 'x'* 'y'?")
    n, plus, star, a, x, y = (h.bit(t) for t in ("NUM", "+", "*", "a", "x", "y"))
    assert h.accepted([n, plus, n, star, n], ("E", "S")) == ["E"] and h.accepted([n, plus], ("E",)) == []
    assert h.accepted([a] * 9, ("S", "L")) == ["S"] and h.accepted([], ("S", "L")) == ["S", "L"] and h.accepted([x, x, y], ("L",)) == ["L"]


def test_long_lists_collapse():
    comma, x = 1, 2
    assert len(S.collapsed((x, comma) * 500 + (x,), comma)) < 12
    assert S.reason("[" + ", ".join(["1"] * 5000) + "]", "json") is None and S.reason("[" + ", ".join(["1"] * 5000) + ", , 2]", "json") is not None


def test_frames(spark):
    rows = [(1, "r", ".PY", "x ="), (2, "r", ".py", "x = 1"), (3, "r", ".env", "= ="), (4, "r", ".json", ""), (5, "r", ".json", None), (None, "r", ".json", "{"), (1, "r", ".PY", "x ="), (6, "q", ".ts", "let x = ;"), (7, "q", None, "x"), (8, "q", ".js", "x = [" + "1," * 200_000 + "]")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "file_id long, repo string, extension string, content string, reason int")
    assert sorted(r["file_id"] for r in S.invalid_files(df).collect()) == [1, 6]
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid"], r["share"]) for r in S.invalid_rates(df).collect()}
    assert rates == {("r", "python"): (2, 1, 0.5), ("r", "json"): (2, 0, 0.0), ("q", "typescript"): (1, 1, 1.0), ("q", "javascript"): (1, 0, 0.0)}
    assert S.invalid_files(df.where("false")).count() == 0


def _differs(path):
    try:
        text = Path(path).read_text(encoding="utf-8-sig")
    except (UnicodeDecodeError, OSError):
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
    return path if ok != (S.reason(text, "python") is None) else None


def test_whole_standard_library_is_judged_as_by_ast():
    files = [str(f) for f in Path(sysconfig.get_paths()["stdlib"]).rglob("*.py") if "site-packages" not in f.parts]
    assert len(files) > 500
    with ProcessPoolExecutor(8, mp_context=get_context("spawn")) as pool:
        assert [x for x in pool.map(_differs, files, chunksize=20) if x] == []


FIELDS = ['{x}', '{{{x}}}', '{1 +}', '{def x}', '{a b}', '{x!r:>{w}.{p}}', '{x = }', '{x=!r}', '{a["b"]}', '{ {1: 2}[1] }', '{x!z y}', '{}', '{x:{}}', '{lambda x: 1}', '{(lambda x: 1)}', '{x!=y}', '{x:%H:%M}', '{yield}', '{*a, b}', '}', '{x', '{x:{y:{z}}}', '{f"{x}"}', "{'a' 'b'}", '{x!}', '{!r}', '{:x}', '{x:a}}b}', '{await y}', '{x if y else z}', '{x;y}', '{x=y}', '{[i for i in x if i]}']


@pytest.mark.parametrize("field", FIELDS)
@pytest.mark.parametrize("head", ['f"', 'rf"', "F'", 'f"""', "f'''"])
def test_fields_of_format_strings(head, field):
    text = f"async def f():\n    s = {head}a {field} b{head.lstrip('rfF')}\n"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            ok = True
        except SyntaxError:
            ok = False
    assert (S.reason(text, "python") is None) == ok


# fixed tables: (text, valid as script, valid as module)
SCRIPTS = [
    ("if (x) /re/.test(y);", True, True), ("while (a) /b/.exec(c);", True, True), ("for (const a of b) /x/g.test(a)", True, True), ("{ a() }\n/re/.test(x)", True, True), ("x = {} / 2;", True, True), ("f(x) / 2", True, True),
    ("obj.if(x) / 2 / 3", True, True), ("yield = 1", True, False), ("var await = 1", True, False), ("let = 5", True, False), ("var static = 1, interface = 2;", True, False), ("let private = 1", True, False), ("await .x", True, False), ("import a from 'b'", False, True), ("export const a = 1", False, True),
    ("export { a }; var x = /[/]/.test(y) / 2", False, True), ("x = a / b / c", True, True), ("if (a) b / c; else /d/.test(e)", True, True), ("if (x) / 2", False, False), ("var 1a = 2", False, False),
]


@pytest.mark.parametrize("text, script, module", SCRIPTS)
def test_scripts_and_modules(text, script, module):
    assert (S.reason(text, "javascript") is None) == (script or module)


@pytest.mark.parametrize("text", ["SELECT * FROM t TABLESAMPLE SYSTEM (10)", "SELECT * FROM t TABLESAMPLE (10 PERCENT) WHERE a", "SELECT * FROM t AS a TABLESAMPLE BERNOULLI (5) REPEATABLE (3)"])
def test_samples_of_tables(text):
    assert S.reason(text, "sql") is None


ELEMENTS = {"json": ["1", '"a"', "{}", "[2]", '{"a": 1}', ""], "python": ["1", "a", "a=1", "*b", "**c", "x for x in y", ""], "javascript": ["1", "a", "...b", "a: 1", "() => {}", ""], "typescript": ["1", "a", "a?: b", "...c: d[]", ""], "java": ["1", "a", "int b", "c -> d", ""], "sql": ["1", "a", "a int", "b AS c", "*", ""], "toml": ["1", '"a"', "[2]", "{b = 1}", ""]}
FRAMES = {"json": "[%s]", "python": "f(%s)\n", "javascript": "f(%s)", "typescript": "function f(%s) {}", "java": "class A { void f() { g(%s); } }", "sql": "SELECT f(%s) FROM t", "toml": "a = [%s]\n"}


@pytest.mark.parametrize("language", ELEMENTS)
def test_shortened_lists_are_judged_like_whole_ones(language, monkeypatch):
    r = random.Random(language)
    texts = []
    for _ in range(60):
        runs = [(r.choice(ELEMENTS[language][: r.choice([2, 2, 4, 9])]), r.choice([1, 2, 3, 4, 30])) for _ in range(r.randint(1, 4))]
        texts.append(FRAMES[language] % ", ".join(e for e, n in runs for _ in range(n)))
    short = [S.reason(t, language) is None for t in texts]
    monkeypatch.setattr(S, "collapsed", lambda tokens, comma: tokens)
    monkeypatch.setattr(S, "_LANGUAGES", {})
    assert short == [S.reason(t, language) is None for t in texts]
    assert any(short) and not all(short)


def test_shortened_suites_are_judged_like_whole_ones(monkeypatch):
    r = random.Random(3)
    lines = ["x = 1", "pass", "if a: b", "else: c", "elif d: e", "for x in y: z", "try: a", "except b: c", "@d", "def f(): g"]
    texts = ["".join(f"{line}\n" * r.choice([1, 1, 2, 3, 4, 7]) for line in r.choices(lines[: r.choice([2, 3, 10])], k=r.randint(1, 6))) for _ in range(200)]
    short = [S.reason(t, "python") is None for t in texts]
    monkeypatch.setattr(S.Python, "_shrunk", lambda self, lines: tuple(lines))
    monkeypatch.setattr(S, "_LANGUAGES", {})
    assert short == [S.reason(t, "python") is None for t in texts]
