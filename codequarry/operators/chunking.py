"""Files to chunks: symbols, whole files, and the split of what is too long."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.functions.languages import PARSED
from codequarry.functions.text import CHARS_PER_TOKEN, base_name, chunk_id, has_content, line_count
from codequarry.parsers.base import Parser, Symbol, file_symbol
from codequarry.parsers.braces import JavaParser, TypeScriptParser
from codequarry.parsers.plain import ConfigParser, SqlParser
from codequarry.parsers.python import PythonParser

CHARS_PER_LINE = 80  # fixed value: the assumed length of a line when an overlap in tokens becomes lines


def default_parsers() -> dict[str, Parser]:
    return {language: parser for parser in (PythonParser(), TypeScriptParser(), JavaParser(), SqlParser(), ConfigParser()) for language in parser.languages}


def symbols_of(text: str, path: str, language: str, parsers: dict[str, Parser], whole_file: bool = False) -> list[Symbol]:
    """The symbols of one file. A syntax-aware extractor that fails leaves the whole file; others let the error through."""
    if whole_file or language not in parsers:
        return [file_symbol(text, path)]
    try:
        return parsers[language].parse(text, path)
    except Exception:
        if language in PARSED:
            return [file_symbol(text, path)]
        raise


def split(text: str, start_line: int, end_line: int, max_tokens: int, overlap_tokens: int, header: str = "") -> list[tuple[str, int, int]]:
    """(text, first line, last line) of the parts of a text that is too long.

    Lines fill a part up to the limit; the next part begins with the overlap's lines of the one before. A line longer than
    the limit stands alone, and a line that did not fit is added behind the overlap whatever its length.
    """
    lines, limit = text.split("\n"), max_tokens * CHARS_PER_TOKEN
    keep = math.ceil(overlap_tokens * CHARS_PER_TOKEN / CHARS_PER_LINE)
    parts, held, size, first = [], [], 0, start_line
    for line in lines:
        if held and size + len(line) + 1 > limit:
            parts.append((header + "\n".join(held), first, first + len(held) - 1))
            dropped = max(0, len(held) - keep)
            first += dropped
            held = held[dropped:] if keep else []
            size = len("\n".join(held))
        held.append(line)
        size += len(line) + 1
    parts.append((header + "\n".join(held), first, end_line))
    return parts


def chunk_rows(symbol: Symbol, max_tokens: int, overlap_tokens: int) -> list[tuple[str | None, int, int, str]]:
    """(name, first line, last line, text) of a symbol's chunks."""
    if math.ceil(len(symbol.text) / CHARS_PER_TOKEN) <= max_tokens:
        text = f"{symbol.doc_comment}\n{symbol.text}" if symbol.doc_comment else symbol.text
        return [(symbol.name, symbol.start_line, symbol.end_line, text)]
    header = f"// In class: {symbol.parent}\n" if symbol.type == "method" and symbol.parent else ""
    parts = split(symbol.text, symbol.start_line, symbol.end_line, max_tokens, overlap_tokens, header)
    named = [f"{symbol.name} (part {k})" if symbol.name and len(parts) > 1 else symbol.name for k in range(1, len(parts) + 1)]
    return [(name, first, last, text) for name, (text, first, last) in zip(named, parts, strict=True)]


_TEXT, _INT, _LIST = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())
_KINDS = {
    "repo": _TEXT, "path": _TEXT, "language": _TEXT, "symbol_type": _TEXT, "symbol_name": _TEXT, "signature": _TEXT, "start_line": _INT, "end_line": _INT,
    "text": _TEXT, "package": _TEXT, "imports": _LIST, "calls": _LIST, "error": _TEXT,
}
_CHUNKED = T.StructType([T.StructField(name, kind) for name, kind in _KINDS.items()])
_ARROW = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.string()] * 2 + [pa.list_(pa.string())] * 2 + [pa.string()]


def chunk_files(files: DataFrame, max_tokens: int = 1000, overlap_tokens: int = 100, whole_file: bool = False, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(repo, path, language, symbol_type, symbol_name, signature, start_line, end_line, text, package, imports, calls, error)
    of all chunks of `files` (repo, relative_path, language, content). Blank files give none; a file whose extractor fails
    gives one row with `error` and no text. Files are independent: no shuffle."""
    own = files.where(has_content(F.col("content"))).select("repo", F.col("relative_path").alias("path"), F.coalesce("language", F.lit("unknown")).alias("language"), "content")
    listed = parsers

    def chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = listed if listed is not None else default_parsers()
        for batch in batches:
            rows: list[tuple] = []
            for repo, path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    for s in symbols_of(text, path or "", language, known, whole_file):
                        for name, first, last, part in chunk_rows(s, max_tokens, overlap_tokens):
                            rows.append((repo, path, language, s.type, name, s.signature, first, last, part, s.package, s.imports, s.calls, None))
                except Exception as e:
                    rows.append((repo, path, language, *[None] * 9, f"{type(e).__name__}: {e}"))
            columns = zip(*rows, strict=True) if rows else [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)], _CHUNKED.names)

    return own.mapInArrow(chunk, _CHUNKED)


def whole_file_chunks(files: DataFrame) -> DataFrame:
    """One chunk per file, without leaving the JVM."""
    own = files.where(has_content(F.col("content")))
    return own.select(
        "repo", F.col("relative_path").alias("path"), "language", F.lit("file").alias("symbol_type"), base_name(F.col("relative_path")).alias("symbol_name"),
        F.lit(1).alias("start_line"), line_count(F.col("content")).alias("end_line"), F.col("content").alias("text"),
    )


def with_ids(chunks: DataFrame, repositories: DataFrame) -> DataFrame:
    """Chunks with their repository's branch, commit, microservice and tags, and their id. `repositories` is one row per
    repository (repo, branch, commit, microservice, tags)."""
    own = repositories.select("repo", "branch", "commit", "microservice", "tags")
    joined = chunks.join(own, "repo", "left")
    c = F.col
    return joined.withColumn("id", chunk_id(c("repo"), c("path"), c("symbol_name"), c("start_line"), c("commit")))


def split_lines(files: DataFrame, max_tokens: int = 1000, overlap_tokens: int = 100) -> DataFrame:
    """(file_id, part, start_line, end_line, n_chars): how `split` cuts whole files, all in one fold of the JVM.

    The fold walks the lines with (first kept line, characters held so far, spans done)."""
    limit, keep = max_tokens * CHARS_PER_TOKEN, math.ceil(overlap_tokens * CHARS_PER_TOKEN / CHARS_PER_LINE)
    lines = files.select("file_id", F.split("content", "\n", -1).alias("l")).withColumn("n", F.expr("transform(l, x -> length(x))"))
    fold = f"""
        aggregate(sequence(0, size(n) - 1), named_struct('s', 0, 'c', 0L, 'done', cast(array() as array<struct<a: int, b: int>>)), (st, i) ->
            if(i > st.s and st.c + n[i] + 1 > {limit},
               named_struct(
                 's', greatest(st.s, i - {keep}),
                 'c', aggregate(slice(n, greatest(st.s, i - {keep}) + 1, i - greatest(st.s, i - {keep})), 0L, (t, x) -> t + x + 1)
                      - if(greatest(st.s, i - {keep}) < i, 1, 0) + n[i] + 1,
                 'done', concat(st.done, array(named_struct('a', st.s, 'b', i - 1)))),
               named_struct('s', st.s, 'c', st.c + n[i] + 1, 'done', st.done)),
            st -> concat(st.done, array(named_struct('a', st.s, 'b', size(n) - 1))))
    """
    spans = lines.select("file_id", "n", F.posexplode(F.expr(fold)).alias("part", "span"))
    chars = F.expr("aggregate(slice(n, span.a + 1, span.b - span.a + 1), 0L, (t, x) -> t + x + 1) - 1")
    return spans.select("file_id", (F.col("part") + 1).alias("part"), (F.col("span.a") + 1).alias("start_line"), (F.col("span.b") + 1).alias("end_line"), chars.alias("n_chars"))
