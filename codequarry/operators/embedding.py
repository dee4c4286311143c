"""Vectors for texts: a pluggable provider inside Arrow batches, and a deterministic one made of Spark expressions."""

from __future__ import annotations

import hashlib
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from codequarry.functions.text import CHARS_PER_TOKEN


class EmbeddingProvider(ABC):
    name: str
    dimension: int
    max_tokens: int = 512
    batch_size: int = 32  # texts of one call of `embed_batch`

    def initialize(self) -> None:
        """Called once in each worker before the first batch."""

    @abstractmethod
    def embed_batch(self, texts: list[str]) -> np.ndarray:
        """One row per text."""

    def embed_all(self, texts: list[str]) -> np.ndarray:
        """One row per text, in order, in calls of at most `batch_size` texts."""
        parts = [self.embed_batch(texts[k : k + self.batch_size]) for k in range(0, len(texts), self.batch_size)]
        return np.concatenate(parts) if parts else np.zeros((0, self.dimension))

    def embed(self, text: str) -> list[float]:
        return [float(x) for x in self.embed_batch([text[: self.max_tokens * CHARS_PER_TOKEN]])[0]]

    def dispose(self) -> None:
        """Frees what `initialize` took."""


@lru_cache(500_000)
def _word_hash(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


class HashingProvider(EmbeddingProvider):
    """Signed feature hashing of lower-case words, L2-normalised. Deterministic and without a model, hence not semantic."""

    name = "local"
    batch_size = 1000

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in enumerate(texts):
            for word in re.split("[^a-z0-9]+", text.lower()):
                if word:
                    h = _word_hash(word)
                    out[row, h % self.dimension] += 1 if (h >> 31) & 1 == 0 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class RemoteProvider(EmbeddingProvider):
    """An HTTP provider: `post(url, headers, body) -> dict` is given by the caller, so that no client library is needed. A request holds
    at most `batch_size` texts. The hosted kind named azure addresses a deployment and names the version of its interface."""

    def __init__(self, name: str, url: str, key: str, model: str, post, dimension: int = 1536, batch_size: int = 100, deployment: str = "", api_version: str = "2024-02-01"):
        self.name, self.url, self.key, self.model, self.post, self.dimension = name, url, key, model, post, dimension
        self.max_tokens, self.batch_size = 8191, batch_size
        if name == "azure":
            self.url = f"{url.rstrip('/')}/openai/deployments/{deployment or model}/embeddings?api-version={api_version}"

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        header = {"api-key": self.key} if self.name == "azure" else {"Authorization": f"Bearer {self.key}"}
        answer = self.post(self.url, header, {"model": self.model, "input": texts})
        return np.array([x["embedding"] for x in sorted(answer["data"], key=lambda x: x["index"])])


def provider_for(config, post=None) -> EmbeddingProvider:
    """The provider that a configuration's `embedding` part names."""
    if config.provider == "local":
        return HashingProvider(config.size)
    if post is None:
        raise ValueError(f"embedding provider {config.provider} needs a transport")
    return RemoteProvider(config.provider, config.url, config.api_key, config.model or "", post, config.size, config.batch_size or 100, config.deployment, config.api_version)


def with_embeddings(chunks: DataFrame, provider: EmbeddingProvider, text: str = "text", column: str = "embedding") -> DataFrame:
    """A vector for each row, in its place: batches go through Arrow, the provider is initialised
    once per task, called with at most its `batch_size` texts, and disposed of at the end."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider.initialize()
        try:
            for texts in batches:
                cut = texts.fillna("").str.slice(0, provider.max_tokens * CHARS_PER_TOKEN)
                yield pd.Series(list(provider.embed_all(cut.tolist()).astype(np.float32)))
        finally:
            provider.dispose()

    return chunks.withColumn(column, vectors(F.col(text)))


def hashed_weights(texts: DataFrame, key: str, text: str, dimension: int = 64) -> DataFrame:
    """(key, bucket, weight): the provider's vectors in long form, by Spark expressions only. Words are summed per bucket before
    anything is shuffled."""
    words = texts.select(key, F.explode(F.split(F.lower(text), "[^a-z0-9]+")).alias("w")).where("w <> ''")
    h = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long")
    sign = F.when(F.shiftright(h, 31) % 2 == 0, 1).otherwise(-1)
    sums = words.select(key, (h % dimension).alias("bucket"), sign.alias("x")).groupBy(key, "bucket").agg(F.sum("x").alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)))  # at most `dimension` rows a key
    return sums.withColumn("norm", length).where("x <> 0").select(key, "bucket", F.round(F.col("x") / F.col("norm"), 6).alias("weight"))
