"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def lines(text: Column) -> Column:
    """Lines by LF; a trailing LF leaves an empty last line."""
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """The lines from `start` to `end`, both counted from 1 and included."""
    return F.array_join(F.slice(lines(text), start, end - start + 1), "\n")


def line_of_offset(text: Column, offset: Column) -> Column:
    """The line (from 1) in which the character at `offset` (from 0) stands."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def token_estimate(text: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.length(text) / F.lit(float(CHARS_PER_TOKEN)))


def truncated(text: Column, tokens: int) -> Column:
    return F.substring(text, 1, CHARS_PER_TOKEN * tokens)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last extension in lower case with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def chunk_key(repo: Column, path: Column, symbol: Column, start_line: Column, commit: Column) -> Column:
    return F.concat_ws(":", repo, path, F.coalesce(symbol, F.lit("")), start_line.cast("string"), commit)


def chunk_id(repo: Column, path: Column, symbol: Column, start_line: Column, commit: Column) -> Column:
    """Sixteen hex digits that depend on repository, path, symbol, first line and commit only."""
    return F.lower(F.lpad(F.hex(F.xxhash64(chunk_key(repo, path, symbol, start_line, commit))), 16, "0"))


def chunk_digest(repo: Column, path: Column, symbol: Column, start_line: Column, commit: Column) -> Column:
    """The same as an MD5, for comparison with other systems."""
    return F.md5(chunk_key(repo, path, symbol, start_line, commit))


def has_content(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def readable(content: Column) -> Column:
    """Bytes to text; bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def short_commit(commit: Column, digits: int = 8) -> Column:
    return F.substring(commit, 1, digits)


def percent(score: Column) -> Column:
    return F.round(score * 100).cast("int")


def score_text(score: Column) -> Column:
    return F.format_string("%.3f", score)


def score_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def line_span(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start.cast("string"), end.cast("string"))
