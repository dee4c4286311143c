"""The engine's calls, as a service would offer them: validated requests in, plain records or texts out."""

from __future__ import annotations

import dataclasses as D
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame

from codequarry.operators import aggregates, rag, render
from codequarry.operators.embedding import EmbeddingProvider
from codequarry.operators.search import FILTERS, results, search
from codequarry.schema import SYMBOL_TYPES


class RequestError(ValueError):
    """A request that breaks the rules; `details` names each field."""

    def __init__(self, details: dict[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in details.items()))
        self.details = details


@D.dataclass
class SearchRequest:
    query: str
    top_k: int = 20
    filters: dict[str, str | None] = D.field(default_factory=dict)
    most: int = 100

    def __post_init__(self):
        wrong = {}
        if not isinstance(self.query, str) or not self.query:
            wrong["query"] = "must not be empty"
        if not isinstance(self.top_k, int) or not 1 <= self.top_k <= self.most:
            wrong["top_k"] = f"must lie between 1 and {self.most}"
        self.filters = {k: v for k, v in (self.filters or {}).items() if k in FILTERS}
        kind = self.filters.get("symbol_type")
        if kind and kind not in SYMBOL_TYPES:
            wrong["filters.symbol_type"] = f"must be one of {', '.join(SYMBOL_TYPES)}"
        if wrong:
            raise RequestError(wrong)


@D.dataclass
class RagRequest:
    query: str
    stream: bool = True
    filters: dict[str, str | None] = D.field(default_factory=dict)

    def __post_init__(self):
        if not isinstance(self.query, str) or not self.query:
            raise RequestError({"query": "must not be empty"})
        self.filters = {k: v for k, v in (self.filters or {}).items() if k in ("repo", "language")}


class Engine:
    def __init__(self, chunks: DataFrame, provider: EmbeddingProvider, generate: rag.Generator | None = None, rag_provider: str = "ollama", rag_key: str | None = None, top_k: int = 10, least: float = 0.5):
        self.chunks, self.provider, self.generate = chunks, provider, generate
        self.rag_provider, self.rag_key, self.top_k, self.least = rag_provider, rag_key, top_k, least

    def search_code(self, request: SearchRequest) -> dict:
        began = time.monotonic()
        found = [r.asDict() for r in search(self.chunks, self.provider.embed(request.query), request.top_k, request.filters).collect()]
        return {"results": found, "total": len(found), "took_ms": int((time.monotonic() - began) * 1000)}

    def list_repositories(self) -> list[str]:
        return [r["repo"] for r in aggregates.list_repositories(self.chunks).collect()]

    def repository_stats(self, repo: str) -> dict:
        return aggregates.stats_record(self.chunks, repo).first().asDict()

    def file_chunks(self, repo: str, path: str) -> list[dict]:
        missing = {n: "is required" for n, v in (("repo", repo), ("path", path)) if not v}
        if missing:
            raise RequestError(missing)
        return [r.asDict() for r in results(aggregates.file_chunks(self.chunks, repo, path)).collect()]

    def rag_status(self) -> dict:
        enabled = self.generate is not None
        return {"enabled": enabled, "configured": rag.is_configured(self.rag_provider, self.rag_key), "provider": self.rag_provider} if enabled else {"enabled": False}

    def rag_query(self, request: RagRequest) -> rag.Answer | Iterator[tuple[str, object]]:
        if self.generate is None or not rag.is_configured(self.rag_provider, self.rag_key):
            raise RuntimeError("answers are not configured")
        found = rag.retrieve(self.chunks, self.provider.embed(request.query), self.top_k, self.least, request.filters)
        return (rag.stream_answer if request.stream else rag.answer)(found, request.query, self.generate)

    def health(self) -> dict:
        try:
            self.chunks.limit(1).count()
            return {"status": "healthy"}
        except Exception as e:
            return {"status": "degraded", "error": str(e)}

    def close(self) -> None:
        """Lets go of what the provider holds; the session belongs to the caller."""
        self.provider.dispose()

    # the same as tool calls that answer with text; top_k is cut to 50 instead of refused
    def tool(self, name: str, arguments: dict) -> dict:
        try:
            return {"text": self._tool(name, arguments), "is_error": False}
        except Exception as e:
            return {"text": f"Error: {e}", "is_error": True}

    def _tool(self, name: str, a: dict) -> str:
        if name == "search_code":
            query = self.provider.embed(a["query"])
            found = search(self.chunks, query, min(a.get("top_k") or 10, 50), {k: a.get(k) for k in FILTERS})
            return render.search_text(found).first()["text"]
        if name == "list_repositories":
            return render.repositories_text(aggregates.list_repositories(self.chunks)).first()["text"]
        if name == "get_repository_stats":
            row = render.stats_text(aggregates.repo_stats(self.chunks.where(self.chunks["repo"] == a["repo"]))).first()
            return row["text"] if row else f"Repository {a['repo']} has no indexed chunks"
        if name == "get_file_chunks":
            return render.file_chunks_text(aggregates.file_chunks(self.chunks, a["repo"], a["path"])).first()["text"]
        raise ValueError(f"unknown tool {name}")
