"""File extension to language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.text import extension

# fixed values: extensions of each language
EXTENSIONS = {
    "java": (".java",),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "python": (".py", ".pyw", ".pyi"),
    "sql": (".sql", ".psql", ".pgsql"),
    "yaml": (".yaml", ".yml"),
    "json": (".json",),
    "config": (".properties", ".toml", ".ini", ".env"),
}
PARSED = ("java", "typescript", "javascript", "python")
BY_EXTENSION = {e: language for language, listed in EXTENSIONS.items() for e in listed}


def language_of(suffix: Column) -> Column:
    """Language of an extension, whatever its case; `unknown` for any other and for null."""
    known = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(suffix)), F.lit("unknown"))


def language_of_path(path: Column) -> Column:
    return language_of(extension(path))


def has_parser(language: Column) -> Column:
    """Whether symbols are read by a syntax-aware extractor."""
    return F.coalesce(language.isin(*PARSED), F.lit(False))


def grammar_name(language: Column) -> Column:
    return F.when(has_parser(language), language)


def supported_extensions() -> list[str]:
    return sorted(BY_EXTENSION)


def supported_languages() -> list[str]:
    return sorted(EXTENSIONS)
