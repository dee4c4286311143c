import pytest

from codequarry.llm import documented as D

LONG = "Moves stale order rows into the yearly archive."

PYTHON = f'''# {LONG}
@deco(
    1,
)
def above(a,
          b):
    return "def fake(): pass"


class A:
    # {LONG}

    def blank(self):
        pass

    async def inner(self) -> dict[str, int]:
        # a remark
        """{LONG}

        :param x: nothing
        """
        def nested():
            r\'\'\'{LONG}\'\'\'
        return {{}}

    def trivial(self): "TBD"

    def tags(self):
        """:param a: one two three four five six seven
        @return eight nine ten eleven twelve"""
'''

SCRIPT = f"""/** {LONG} */
export async function plain(a: string, {{ b }} = {{}}): Promise<void> {{
  const text = "}} // no";
  return;
}}

// {LONG}
// @param x y
export const arrow = async (a: number): Promise<number> => a + 1;

/* {LONG} */

function blank() {{}}

class K {{
  /**
   * {LONG}
   */
  @Dec({{ a: 1 }})
  private static async method<T>(x: T[]): Promise<T> {{
    // {LONG}
    helper(x);
    // {LONG}
    if (x) {{ }}
    return x[0];
  }}
  x = 1; // {LONG}
  other() {{ }}
  // Publish manual archive the publishes archives
  publishManualArchive() {{}}
}}
// {LONG}
const value = list.filter((x) => x.y);
"""

JAVA = f"""class A {{
    /**
     * {LONG}
     * @param x the x of all the things in there
     */
    @Override
    @Sup("a(b")
    public static <T> Map<String, T> run(int x, List<T> y) throws E {{ return null; }}

    // {LONG}
    abstract int bare(int x);

    /* {LONG} */
    A(int x) {{ }}

    void f() {{
        // {LONG}
        g.run(1);
        // {LONG}
        return h(2);
    }}
}}
"""


def names(text, language):
    return [(n, line) for n, line, *_ in D.functions_of(text, language)]


@pytest.mark.parametrize("text, language, want", [(PYTHON, "python", [("above", 5), ("inner", 16), ("nested", 22)]), (SCRIPT, "typescript", [("plain", 2), ("arrow", 9), ("method", 20)]), (JAVA, "java", [("run", 8), ("bare", 11), ("A", 14)])])
def test_described_functions(text, language, want):
    assert names(text, language) == want
    assert names(text.replace("\n", "\r\n"), language) == want


def test_texts_and_signatures():
    found = {n: (sig, doc, text) for n, _, sig, doc, text in D.functions_of(SCRIPT, "typescript")}
    assert found["plain"][0] == "export async function plain(a: string, { b } = {}): Promise<void>" and found["plain"][2].endswith("return;\n}")
    assert found["arrow"][2].startswith("export const arrow") and found["method"][2].startswith("private static async method")
    python = {n: text for n, _, _, _, text in D.functions_of(PYTHON, "python")}
    assert python["above"].endswith('pass"') and python["inner"].endswith("return {}")


@pytest.mark.parametrize("raw, name, left", [("TBD", "f", 1), ("Upload extra stable.", "upload_extra_stable", 0), ("Uploads the extra stable", "uploadExtraStable", 0), ("/** a b\n * @param c d\n * e */", "f", 3), ("", "f", 0), ("// {@inheritDoc}", "f", 1)])
def test_words_left(raw, name, left):
    assert D.words_left(raw, name) == left


def test_frames(spark):
    rows = [(1, ".PY", PYTHON), (1, ".PY", PYTHON), (2, ".py", PYTHON + "def broken(:\n"), (3, ".py", None), (None, ".py", PYTHON), (4, ".sql", "-- a"), (5, ".js", ""), (6, None, "x"), (7, ".java", JAVA + "\n" * 300_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id long, extension string, content string, signature string")
    assert sorted((r["file_id"], r["symbol_name"]) for r in D.described_names(df).collect()) == [(1, "above"), (1, "inner"), (1, "nested"), (7, "A"), (7, "bare"), (7, "run")]
    assert D.documented_functions(df).count() == 6 and D.documented_functions(df.where("false")).count() == 0


def _rows(text, language):
    return {r[0]: r for r in D.functions_of(text, language)}


def test_nested_template_literals_keep_the_count_of_braces():
    text = "// Joins all of the given parts into one line.\nfunction join(a) {\n  return `x${a.map((b) => `}${b ? `{${b}` : '}'}`).join(`,`)}`;\n}\n\n// Splits the given line into all of its parts.\nfunction split(a) {\n  return a;\n}\n"
    rows = _rows(text, "javascript")
    assert set(rows) == {"join", "split"} and rows["join"][4].endswith("`;\n}") and rows["split"][4] == "function split(a) {\n  return a;\n}"
    arrow = "// Makes one long text out of the two parts.\nconst make = (a) => `${`${a}`}` + f({ b: [1, 2] }, `,`);\nconst other = 1;\n"
    assert _rows(arrow, "javascript")["make"][4].endswith("`,`)")


def test_long_type_parameters_and_decorators_are_read_whole():
    types = ", ".join(f"T{k} extends {{ a{k}: string; f(x: number): Map<string, T0> }}" for k in range(300))
    text = f"/** Sends every part of the message to its own place. */\nexport function send<{types}>(a: T0): void {{\n}}\n"
    assert set(_rows(text, "typescript")) == {"send"} and len(types) > 10_000
    cases = "".join(f"    ({k}, [{k}, {{'a': ({k},)}}]),\n" for k in range(1000))
    python = f"# Checks that every one of the cases gives its own list.\n@mark.parametrize('a, b', [\n{cases}])\n@other\ndef check(a, b):\n    pass\n"
    assert set(_rows(python, "python")) == {"check"}
    java = "class A {\n  // Sends every part of the message to its own place.\n  @A({" + "\n    @B(x = {1, 2}),\n" * 500 + "  })\n  void send() { }\n}\n"
    assert set(_rows(java, "java")) == {"send"}


def test_deeply_nested_functions_take_time_in_proportion():
    import time

    def nested(n):
        head = "".join(f"// Opens level number {k} of the whole deep tree.\nfunction level{k}() {{\n" for k in range(n))
        return head + "}\n" * n

    took = []
    for n in (500, 4000):
        text, began = nested(n), time.perf_counter()
        assert len(_rows(text, "javascript")) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] * 6  # far below the square of 8
