import re

import pytest
from pyspark.sql import functions as F

from codequarry.functions import globs, languages, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name, language", [("a.TS", "typescript"), ("b.mjs", "javascript"), ("C.java", "java"), ("d.pyi", "python"), ("e.psql", "sql"), ("f.yml", "yaml"), ("g.json", "json"), ("prod.env", "config"), (".env", "unknown"), ("h.md", "unknown"), ("Makefile", "unknown")])
def test_language_of_path(spark, name, language):
    assert one(spark, languages.language_of_path(F.col("p")), p=f"src/x/{name}") == language


def test_languages_have_no_extension_twice():
    assert len(languages.supported_extensions()) == sum(len(x) for x in languages.EXTENSIONS.values())
    assert languages.supported_languages() == sorted(languages.EXTENSIONS)


@pytest.mark.parametrize("pattern, path, ok", [("src/**/*", "src/a.ts", True), ("src/**/*", "src/a/b.ts", True), ("src/**/*", "lib/a.ts", False), ("**/x", "x", True), ("**/x", "a/b/x", True), ("*.js", "a/b.js", False), ("a?c", "abc", True), ("**/*.{ts,js}", "q/w.js", True), ("a.b", "axb", False)])
def test_path_globs(pattern, path, ok):
    assert bool(re.match(globs.path_regex(pattern), path)) is ok


def test_ignore_rules_have_five_shapes():
    found = globs.ignore_globs(["dist/", "*.log", "/build", "docs/out", "", "# note", "!keep"])
    assert found == ["**/dist/**", "dist/**", "**/*.log", "**/*.log/**", "build", "build/**", "docs/out", "**/docs/out", "docs/out/**", "**/docs/out/**"]


def test_names_need_an_include_and_no_exclude(spark):
    keep = globs.matches_names(F.col("n"), ["repo*"], ["*-old"])
    assert [one(spark, keep, n=n) for n in ("repo1", "repo-old", "other")] == [True, False, False]


def test_hidden_and_git_paths_are_left_out(spark):
    keep = globs.matches_paths(F.col("p"), ["**/*"])
    assert [one(spark, keep, p=p) for p in ("a/b.ts", ".git/x", "a/.hidden/x.ts", ".env")] == [True, False, False, False]


@pytest.mark.parametrize("value, lines", [("a\nb\n", 3), ("", 1), ("a", 1), ("\n\n", 3)])
def test_line_count(spark, value, lines):
    assert one(spark, text.line_count(F.col("t")), t=value) == lines


def test_line_slices_and_offsets(spark):
    assert one(spark, text.line_slice(F.col("t"), F.lit(2), F.lit(3)), t="a\nb\nc\nd") == "b\nc"
    assert [one(spark, text.line_of_offset(F.col("t"), F.lit(k)), t="ab\ncd") for k in (0, 2, 3)] == [1, 1, 2]


def test_tokens_and_truncation(spark):
    assert one(spark, text.token_estimate(F.col("t")), t="x" * 9) == 3
    assert one(spark, text.truncated(F.col("t"), 5), t="ABCDEFGHIJ" + "X" * 100) == "ABCDEFGHIJXXXXXXXXXX"


def test_chunk_ids_depend_on_every_part(spark):
    c = F.col
    key = text.chunk_id(c("r"), c("p"), c("s"), c("l"), c("m"))
    base = {"r": "repo", "p": "a.ts", "s": "f", "l": 3, "m": "abc"}
    seen = {one(spark, key, **base)} | {one(spark, key, **(base | {k: v})) for k, v in (("r", "q"), ("p", "b.ts"), ("s", "g"), ("l", 4), ("m", "x"))}
    assert len(seen) == 6 and one(spark, key, **base) in seen
    assert len(spark.createDataFrame([("r", "p", None, 1, "m")], "r string, p string, s string, l int, m string").select(key.alias("x")).first()["x"]) == 16


def test_bytes_become_readable(spark):
    row = spark.createDataFrame([(bytearray(b"ab\xffc"),)], "b binary").select(text.readable(F.col("b")).alias("x")).first()
    assert row["x"] == "ab�c"


def test_extension_of_dot_files(spark):
    assert [one(spark, text.extension(F.col("p")), p=p) for p in ("a/b.TS", "a/.env", "x.tar.gz", "a/b")] == [".ts", "", ".gz", ""]
