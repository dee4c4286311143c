"""Configuration: a YAML file with `${VAR}` and `${VAR:-default}`, checked into dataclasses."""

from __future__ import annotations

import dataclasses as D
import os
import re
from typing import Any

from codequarry.schema import EMBEDDING_PROVIDERS, RAG_PROVIDERS

_VARIABLE = re.compile(r"\$\{([^}:]+)(?::-([^}]*))?\}")


class ConfigError(ValueError):
    """All problems of a configuration, each with its path."""


def expanded(value: Any, env: dict[str, str] | None = None) -> Any:
    """Variables replaced in strings, lists and maps; a variable that is set wins over its default even when empty."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: env.get(m[1], m[2] or ""), value)
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    return value


@D.dataclass
class Store:
    url: str = "file:///tmp/code-chunks"
    index: str = "code-chunks"


@D.dataclass
class Embedding:
    provider: str = "local"
    dimension: int | None = None
    model: str | None = None
    batch_size: int | None = None  # texts of one request
    url: str = ""
    api_key: str = ""
    deployment: str = ""
    api_version: str = "2024-02-01"
    # fixed values: vector sizes of the providers' default models
    DIMENSIONS = {"local": 384, "openai": 1536, "azure": 1536}

    @property
    def size(self) -> int:
        return self.dimension or self.DIMENSIONS[self.provider]


@D.dataclass
class Files:
    root: str = ""
    repos_include: list[str] = D.field(default_factory=lambda: ["*"])
    repos_exclude: list[str] = D.field(default_factory=list)
    include: list[str] = D.field(default_factory=lambda: ["src/**/*"])
    exclude: list[str] = D.field(default_factory=list)
    use_gitignore: bool = True
    overrides: dict[str, dict] = D.field(default_factory=dict)


@D.dataclass
class Chunking:
    max_tokens: int = 1000
    overlap_tokens: int = 100
    whole_file: bool = False


@D.dataclass
class Rag:
    enabled: bool = False
    provider: str = "ollama"
    top_k: int = 10
    min_score: float = 0.5
    max_tokens: int = 4096
    api_key: str | None = None


@D.dataclass
class Config:
    store: Store = D.field(default_factory=Store)
    embedding: Embedding = D.field(default_factory=Embedding)
    files: Files = D.field(default_factory=Files)
    chunking: Chunking = D.field(default_factory=Chunking)
    rag: Rag = D.field(default_factory=Rag)


def _checked(config: Config) -> Config:
    wrong = []

    def need(ok: bool, path: str, what: str) -> None:
        if not ok:
            wrong.append(f"{path}: {what}")

    need(bool(re.match(r"^[a-z][a-z0-9+]*://", config.store.url)), "store.url", "must be a URL")
    need(config.embedding.provider in EMBEDDING_PROVIDERS, "embedding.provider", f"must be one of {', '.join(EMBEDDING_PROVIDERS)}")
    need(config.rag.provider in RAG_PROVIDERS, "rag.provider", f"must be one of {', '.join(RAG_PROVIDERS)}")
    need(bool(config.files.root), "files.root", "is required")
    need(config.chunking.max_tokens > 0, "chunking.max_tokens", "must be positive")
    need(config.chunking.overlap_tokens >= 0, "chunking.overlap_tokens", "must not be negative")
    need(0 <= config.rag.min_score <= 1, "rag.min_score", "must lie between 0 and 1")
    if wrong:
        raise ConfigError("; ".join(wrong))
    return config


def config_from(data: dict, env: dict[str, str] | None = None) -> Config:
    """A checked configuration from a parsed document; unknown keys are ignored."""
    data, parts, wrong = expanded(data or {}, env), {}, []
    for field in D.fields(Config):
        kind = field.default_factory
        own = data.get(field.name) or {}
        names = {f.name for f in D.fields(kind)}
        try:
            parts[field.name] = kind(**{k: v for k, v in own.items() if k in names})
        except TypeError as e:
            wrong.append(f"{field.name}: {e}")
    if wrong:
        raise ConfigError("; ".join(wrong))
    return _checked(Config(**parts))


def load_config(path: str, env: dict[str, str] | None = None) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return config_from(yaml.safe_load(f), env)
