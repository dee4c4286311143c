import random

from codequarry.llm import provenance as P

HAND = """import {{ Store }} from "./store";

// Keeps the {a} in step with the {b}.
export function {a}(input: string[]): number {{
  let total = 0;
  for (const part of input) {{
    if (part.length > {n}) {{
      total += part.length;
    }}
  }}
  try {{
    Store.save("{a}", total);
  }} catch (error) {{
    console.warn(error);
  }}
  return total;
}}
"""


def corpus():
    r = random.Random(1)
    words = "load save parse merge filter group count render encode cache order user price event batch".split()
    name = lambda: r.choice(words) + r.choice(words).title() + r.choice(words).title()
    rows = [(k, "app", f"src/{name()}.ts", ".ts", HAND.format(a=name(), b=r.choice(words), n=k)) for k in range(60)]
    mini = "!function(e,t){" + "".join(f"function q{chr(97 + k % 26)}{chr(97 + k // 26)}z(x{k}){{return x{k}.{name()}?x{k}[{k}]:t}}" for k in range(60)) + "}();"
    rows += [
        (100, "app", "dist/app.min.js", ".js", mini), (101, "app", "src/odd.js", ".JS", mini), (102, "app", "src/blob.ts", ".ts", 'export const data = "' + "Ab3/" * 300 + '";\n'),
        (103, "app", "src/records.json", ".json", "[" + ",".join(f'{{"id": {k}, "tag": "t{k}"}}' for k in range(40)) + "]"), (104, "app", "config/small.json", ".json", '{"a": {"b": 1, "c": "x"}}'),
        (105, "app", "api/types.ts", ".ts", "".join(f"export interface T{k} {{\n  {name()}: {name()};\n  {name()}?: string;\n}}\n" for k in range(12))),
        (106, "app", "src/gen.py", ".py", "# Code generated by protogen. DO NOT EDIT.\n" + "".join(f"class M{k}(object):\n    __slots__ = ('a', 'b')\n    FIELD_{k} = 1\n" for k in range(10))),
        (107, "app", "third_party/acme/tool.ts", ".ts", HAND.format(a="toolRun", b="x", n=1)), (108, "app", "src/acme/tool.ts", ".ts", "/*\n * Vendored from acme at 1f2e3d4c5b; see there\n */\n" + HAND.format(a="toolRun", b="y", n=2)),
        (109, "app", "src/talk.ts", ".ts", "// do not edit the order without asking; ids are generated by the store\n" + HAND.format(a="talkOver", b="z", n=3)), (110, "app", "web/package-lock.json", ".json", '{"lockfileVersion": 3, "packages": {' + ",\n".join(f'"p{k}": {{"version": "1.0.{k}"}}' for k in range(20)) + "}}"),
        (111, "app", "src/sales/vendor/branch/ownPart.ts", ".ts", HAND.format(a="ownPart", b="q", n=4)), (112, "app", None, None, None), (113, "app", "src/empty.ts", ".ts", ""), (100, "app", "dist/app.min.js", ".js", mini),
        (114, "app", "out/main.js", ".js", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\n' + "".join(f"exports.f{k} = f{k};\nfunction f{k}(a) {{ return b(a, {k}); }}\n" for k in range(8))),
    ]
    return rows


def test_files(spark):
    df = spark.createDataFrame([(*r, "clash") for r in corpus()], "file_id long, repo string, relative_path string, extension string, content string, reason string")
    found = {r["file_id"]: r["reason"] for r in P.flagged_files(df).collect()}
    assert found == {100: "minified", 101: "minified", 102: "data", 103: "data", 105: "generated", 106: "generated", 107: "vendored", 108: "vendored", 110: "generated", 114: "generated"}
    assert P.handwritten_files(df).count() == df.count() - 11
    assert sum(r["files"] for r in P.reasons_by_repo(df).collect()) == 10


def test_empty_table(spark):
    df = spark.createDataFrame([], "file_id long, repo string, relative_path string, extension string, content string")
    assert P.flagged_files(df).count() == 0


def test_model_tells_mangled_names_from_spoken_ones():
    names = ["loadUserOrder", "saveCacheBatch", "merge_event_group", "renderPrice", "parseFilter"] * 20
    codes, _ = P.gram_codes(names)
    grams = {}
    for c in codes.tolist():
        grams[c] = grams.get(c, 0) + 1
    model = P.NameModel(grams)
    assert model.entropy(["qxz", "zvq", "jkw"]) > model.entropy(["mergeUser", "loadPrice"]) + 1

LICENCE = "/*\n" + " * Permission is granted to whoever holds a copy of this text, without any warranty.\n" * 30 + " */\n"


def judged(text, path="src/part.ts", extension=".ts"):
    return P.verdict(P.features(text, path, extension, {}))


def test_origins_and_notes_count_wherever_their_comment_stands():
    hand = HAND.format(a="toolRun", b="y", n=2)
    small = "export const a = 1;\n" * 3
    origin = "// copied from acme at v1.2\n"
    for text in (LICENCE + origin + hand, hand * 3 + origin, hand + "/* vendored from acme at 1f2e3d4c5b */ " + hand):
        assert judged(text) == "vendored"
    varied = "import os\nfrom os import path\nX = path.sep\nfor a in X:\n    print(a)\nwhile X:\n    break\nclass A(B):\n    y: int = 1\ndef f(a, b):\n    return a + b\nassert f(1, 2)\n" + f"z = [{', '.join(['1'] * 9)}]\n" * 90
    assert judged(varied, "a/b.py", ".py") is None
    assert judged(varied + "# adapted from acme 1.2\nx = os.sep\n", "a/b.py", ".py") == "vendored"
    assert judged(LICENCE + "// Code generated by acme. DO NOT EDIT.\n" + small) == "generated"
    assert judged(small + "x();\n" * 2 + LICENCE + "// This file was automatically generated by acme.\n") == "generated"


def test_words_inside_functions_and_strings_are_no_note():
    body = 'function f() {\n  // copied from acme at v1.2\n  const a = "// copied from acme at v1.2";\n}\n'
    assert judged(body) is None and judged('const banner = "Code generated by acme. DO NOT EDIT.";\n') is None
    assert judged("class A {\n  // Auto-generated method stub\n  void f() { }\n}\n", "src/A.java", ".java") is None
    assert judged('{"note": "Code generated by acme. DO NOT EDIT.", "a": {"b": 1}}', "config/a.json", ".json") == "generated"


def mangled_code():
    r = random.Random(3)
    names = sorted({"".join(r.choice("qxzjkwvy") for _ in range(r.randint(2, 3))) for _ in range(200)})
    return "".join(f"function {a}({b},{c}){{return {b}.{c}({a},{k})}}" for k, (a, b, c) in enumerate(zip(names, names[7:], names[19:], strict=False)))


def test_mangled_names_are_judged_whatever_the_lines():
    codes, _ = P.gram_codes(["loadUserOrder", "saveCacheBatch", "mergeEventGroup", "renderPrice", "parseFilter"] * 20)
    models = {"script": P.NameModel({c: codes.tolist().count(c) for c in set(codes.tolist())})}
    reason = lambda text: P.verdict(P.features(text, "src/part.js", ".js", models))
    code = mangled_code()
    assert reason(code) == "minified" and reason(code.replace("}function", "}\nfunction").replace(";", ";\n")) == "minified"
    assert reason(LICENCE + "//\n" * 60 + code[: code.rindex("}function", 0, 3900) + 1]) == "minified"
    assert reason(HAND.format(a="loadOrder", b="y", n=2)) is None


def test_line_shapes_count_against_the_lines():
    forms = ("export const {n} = 1;", "export function {n}(): void {{", "  return call({n}, 2);", "}}", "export type {n} = string;", "  if (x.{n}) return;", "  x.{n} = [1, 2];", "let {n};")
    text = "\n".join(form.format(n=f"part{k}") for k in range(250) for form in forms)
    assert judged(text) == "generated"


def test_a_clear_note_decides_whatever_the_shapes():
    hand = HAND.format(a="toolRun", b="y", n=2)
    assert judged(hand) is None
    for note in ("// Code generated by acme. DO NOT EDIT.\n", "/*\n * This file is automatically generated by acme.\n */\n", "// @generated\n"):
        assert judged(note + hand) == "generated"
    for talk in ("// Please do not edit.\n", "// Runs the code generated by the planner.\n", "// Keeps the ids that are\n// generated by the store.\n"):
        assert judged(talk + "a(1);\n" + hand.replace("total", "sum")) is None


PYTHON = [
    "def {a}(x):\n    return x.{b}({k})\n", "{a} = [{b}, {k}]\n", "for x in {a}:\n    {b}.append(x + {k})\n", "if {a} > {k}:\n    raise ValueError({b})\n", "with {a}({b}) as f:\n    f.write('{k}')\n", "{a} = {{'x': {b}}}\n", "assert {a}({b}) == {k}\n",
    "class X{k}:\n    y = {a}\n\n    def {b}(self):\n        pass\n", "while {a}:\n    {b} -= {k}\n", "try:\n    {a}()\nexcept KeyError:\n    {b} = None\n", "{a} = lambda x: x[{b}]\n", "del {a}[{k}:{b}]\n",
]


def styled_corpus():
    """Hand-written files in kebab and camel case, copies from elsewhere and mangled bundles, none with a telling path or phrase."""
    r = random.Random(2)
    words = "load save parse merge filter group count render encode cache order user price event batch".split()
    name = lambda: r.choice(words) + r.choice(words).title() + r.choice(words).title()
    hand = lambda n: HAND.format(a=n, b=r.choice(words), n=r.randint(1, 99)) + "".join(f"const {name()} = {name()}({k});\n" for k in range(20))
    kebab = lambda: f"{r.choice(words)}-{r.choice(words)}-{r.randint(1, 999)}"
    rows = [(k, f"repo{k % 4}", f"src/{kebab() if k % 2 else name()}.ts", ".ts", hand(name())) for k in range(400)]
    rows += [(1000 + k, f"repo{k}", f"src/{name()[0].upper()}{name()[1:]}.ts", ".ts", hand(name())) for k in range(3)]  # PascalCase
    python = lambda: "".join(r.choice(PYTHON).format(a=f"{r.choice(words)}_{r.choice(words)}", b=f"{r.choice(words)}_{r.choice(words)}", k=k) for k in range(24))
    rows += [(2000 + k, "repo0", f"lib/{r.choice(words)}_{r.choice(words)}_{k}.py", ".py", python() + f"X_{k} = {k}\n") for k in range(300)]
    camel = "import os\n" + "".join(r.choice(PYTHON).format(a=name(), b=name(), k=k) for k in range(24))
    rows += [(3000, "repo0", "lib/parseOrderTree.py", ".py", camel), (3001, "repo0", "lib/CacheTree.py", ".py", python())]
    rows += [(4000 + k, "repo1", f"src/{kebab()}.js", ".js", mangled_code().replace("}function", "}\nfunction").replace(";", ";\n").replace("{return", "{\nreturn")) for k in range(2)]
    return rows


def _flagged(spark, rows):
    df = spark.createDataFrame(rows, "file_id long, repo string, relative_path string, extension string, content string")
    return {r["file_id"]: r["reason"] for r in P.flagged_files(df).collect()}


PLANTED = {1000: "vendored", 1001: "vendored", 1002: "vendored", 3000: "vendored", 3001: "vendored", 4000: "minified", 4001: "minified"}


def test_models_and_styles_find_what_no_path_or_phrase_shows(spark):
    assert _flagged(spark, styled_corpus()) == PLANTED


def test_without_models_or_styles_planted_files_are_lost(spark, monkeypatch):
    rows = styled_corpus()
    with monkeypatch.context() as m:  # styles off
        m.setattr(P, "_foreign_styles", lambda scored, *_: scored.where("false").select("file_id"))
        assert set(_flagged(spark, rows)) == {4000, 4001}
    with monkeypatch.context() as m:  # models off: names without a model have no entropy
        m.setattr(P, "name_models", lambda files: {})
        assert {i for i, why in _flagged(spark, rows).items() if why == PLANTED.get(i)} == set(PLANTED) - {4000, 4001}


def test_without_paths_and_phrases_most_planted_files_are_found(spark):
    """The planted files of both fixtures, moved to plain paths and without their comments' phrases."""
    rows = [x for x in corpus() if x[4]] + styled_corpus()
    planted = set(_flagged(spark, rows))
    plain = [
        (i, repo, f"src/part{i}{ext or ''}" if i < 200 else path, ext, P._ORIGIN.sub("", P._GENERATED.sub("", P._TOOL_OUTPUT.sub("", text))))
        for i, repo, path, ext, text in rows
    ]
    assert len(planted & set(_flagged(spark, plain))) >= 0.75 * len(planted)


def test_identifier_styles():
    assert P.identifier_style([f"loadUser{k}x" for k in range(20)]) == "camel" and P.identifier_style([f"load_user_{k}" for k in range(20)]) == "snake"
    assert P.identifier_style(["loadUser"]) == "" and P.identifier_style(["A_B"] * 30) == ""
