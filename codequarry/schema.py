"""The engine's data model: one table of code chunks and the records around it."""

from __future__ import annotations

from pyspark.sql import types as T

S, I = T.StringType(), T.IntegerType()
STRINGS = T.ArrayType(S)

# fixed values: languages, symbol types and providers that requests and files may name
LANGUAGES = ("java", "typescript", "javascript", "python", "sql", "yaml", "json", "config", "unknown")
SYMBOL_TYPES = ("file", "class", "interface", "enum", "function", "method", "block")
EMBEDDING_PROVIDERS = ("openai", "azure", "local")
RAG_PROVIDERS = ("ollama", "openai-compatible", "openrouter", "openai")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


REPOSITORY = _struct(name=S, path=S, branch=S, commit=S, microservice=S, tags=STRINGS)
FILE = _struct(repo=S, absolute_path=S, relative_path=S, language=S, extension=S)
SYMBOL = _struct(type=S, name=S, signature=S, start_line=I, end_line=I, text=S, doc_comment=S, parent=S, package=S, imports=STRINGS, calls=STRINGS)
CODE_CHUNK = _struct(
    id=S, repo=S, branch=S, commit=S, path=S, language=S, microservice=S, symbol_type=S, symbol_name=S, signature=S, start_line=I, end_line=I,
    text=S, package=S, imports=STRINGS, calls=STRINGS, aggregate=S, tags=STRINGS, embedding=T.ArrayType(T.FloatType()),
)
RESULT_COLUMNS = ("id", "score", "repo", "path", "language", "microservice", "symbol_type", "symbol_name", "signature", "start_line", "end_line", "text")
