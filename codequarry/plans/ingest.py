"""The whole pipeline: repositories, files, chunks, vectors, chunk table."""

from __future__ import annotations

import dataclasses as D
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.config import Config
from codequarry.functions.text import has_content
from codequarry.operators.chunking import chunk_files, with_ids
from codequarry.operators.embedding import EmbeddingProvider, provider_for, with_embeddings
from codequarry.operators.store import ChunkStore
from codequarry.schema import CODE_CHUNK
from codequarry.session import cut
from codequarry.sources.files import enumerate_repositories
from codequarry.sources.repos import discover

log = logging.getLogger(__name__)


@D.dataclass
class IngestResult:
    repositories: int = 0
    files: int = 0
    chunks: int = 0
    indexed: int = 0
    failed: int = 0
    errors: list[str] = D.field(default_factory=list)


SHOWN_ERRORS = 10


def chunked(files: DataFrame, config: Config) -> DataFrame:
    """Chunks and failures of a file table (repo, relative_path, language, content), in one table."""
    c = config.chunking
    return chunk_files(files, c.max_tokens, c.overlap_tokens, c.whole_file)


def chunk_rows_of(made: DataFrame, repositories: DataFrame) -> DataFrame:
    """The chunks of `chunked`, without vectors."""
    named = with_ids(made.where("error is null and text is not null"), repositories).withColumn("aggregate", F.lit(None).cast("string"))
    return named.select(*[n for n in CODE_CHUNK.names if n != "embedding"])


def ingest(
    spark: SparkSession, config: Config, store: ChunkStore | None = None, repo: str | None = None, dry_run: bool = False, provider: EmbeddingProvider | None = None,
    progress: Callable[[str, int, int], None] | None = None, batch: int = 64,
) -> IngestResult:
    """Index all repositories under the configured root, or one. A dry run counts and writes nothing.

    Files are read and parsed once: chunks and failures are cut into one table, from which everything else comes. Repositories are
    stored `batch` at a time, each replacing its partition in one commit, so that an empty repository loses its old chunks and a
    failure leaves the old ones in place; `progress(stage, done, total)` is told after each batch. All failures stay in a table
    (`<store>-failures` beside the store); only the first are fetched.
    """
    f, out = config.files, IngestResult()
    tell = progress or (lambda stage, done, total: log.info("%s: %d of %d", stage, done, total))
    found = discover(spark, f.root, [repo] if repo else f.repos_include, [] if repo else f.repos_exclude)
    rows = found.collect()  # directories directly under the root
    out.repositories = len(rows)
    if not rows:
        return out
    over = f.overrides
    repositories = spark.createDataFrame(
        [(r["name"], r["branch"], r["commit"], over.get(r["name"], {}).get("microservice"), over.get(r["name"], {}).get("tags")) for r in rows],
        "repo string, branch string, commit string, microservice string, tags array<string>",
    )
    files = enumerate_repositories(spark, [(r["name"], r["path"]) for r in rows], f.include, f.exclude, f.use_gitignore)
    # a row without text and error for each file, so that files are counted by the same scan
    blank = files.where(~F.coalesce(has_content(F.col("content")), F.lit(False)))
    made = chunked(files, config)
    made = cut(made.unionByName(blank.select("repo", F.col("relative_path").alias("path"), F.lit(None).cast("string").alias("text")), allowMissingColumns=True))
    counts = {
        r["repo"]: r for r in made.groupBy("repo").agg(F.count("text").alias("chunks"), F.count("error").alias("failed"), F.countDistinct("path").alias("files")).collect()  # one row a repository
    }
    out.files, out.chunks, out.failed = (sum(r[k] for r in counts.values()) for k in ("files", "chunks", "failed"))
    bad = made.where("error is not null").select("repo", "path", "error")
    out.errors = [f"{r['repo']}/{r['path']}: {r['error']}" for r in bad.orderBy("repo", "path").limit(SHOWN_ERRORS).collect()]
    tell("parsed", out.files, out.files)
    if dry_run:
        return out
    store = store or ChunkStore(spark, f"{config.store.url.rstrip('/')}/{config.store.index}")
    store.create()
    if out.failed:
        bad.write.mode("overwrite").parquet(f"{store.path.rstrip('/')}-failures")
    names = sorted(r["name"] for r in rows)
    for at in range(0, len(names), batch):
        part = names[at : at + batch]
        filled = [n for n in part if n in counts and counts[n]["chunks"]]
        if filled:
            own = chunk_rows_of(made.where(F.col("repo").isin(filled)), repositories)
            store.replace(with_embeddings(own, provider or provider_for(config.embedding)))
        for name in part:
            if name not in filled:
                store.delete_repo(name)
        out.indexed += sum(counts[n]["chunks"] for n in filled)
        tell("indexed", out.indexed, out.chunks)
    return out
