"""Counts over the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# fixed values: how many buckets each listing shows
LANGUAGE_BUCKETS, SYMBOL_BUCKETS, REPOSITORY_BUCKETS = 50, 20, 1000


def repo_count(chunks: DataFrame, repo: str) -> DataFrame:
    return chunks.where(F.col("repo") == repo).agg(F.count("*").alias("chunks"))


def list_repositories(chunks: DataFrame, most: int = REPOSITORY_BUCKETS) -> DataFrame:
    """(repo, chunks): the repositories with the most chunks first, then by name."""
    return chunks.where("repo is not null").groupBy("repo").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "repo").limit(most)


def repo_stats(chunks: DataFrame) -> DataFrame:
    """(repo, facet, value, chunks) in long form: the total, and the counts by language and by symbol type, from one scan with
    grouping sets; each facet keeps its largest buckets."""
    counted = (
        chunks.groupingSets([["repo"], ["repo", "language"], ["repo", "symbol_type"]], "repo", "language", "symbol_type")
        .agg(F.count("*").alias("chunks"), F.grouping_id().alias("g"))
    )
    facet = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "language").otherwise("symbol_type")
    named = counted.withColumn("facet", facet).withColumn("value", F.when(F.col("facet") == "total", "all").otherwise(F.coalesce("language", "symbol_type")))
    rank = F.row_number().over(W.partitionBy("repo", "facet").orderBy(F.desc("chunks"), "value"))
    most = F.when(F.col("facet") == "language", LANGUAGE_BUCKETS).otherwise(SYMBOL_BUCKETS)
    return named.where("value is not null").withColumn("rank", rank).where(F.col("rank") <= most).select("repo", "facet", "value", "chunks")


def stats_record(chunks: DataFrame, repo: str) -> DataFrame:
    """(repo, total_chunks, by_language, by_symbol_type): one row with two maps; an unknown repository has zeros."""
    long = repo_stats(chunks.where(F.col("repo") == repo))
    pick = lambda facet: F.map_from_entries(F.collect_list(F.when(F.col("facet") == facet, F.struct("value", "chunks"))))
    return long.agg(F.lit(repo).alias("repo"), F.coalesce(F.sum(F.when(F.col("facet") == "total", F.col("chunks"))), F.lit(0)).alias("total_chunks"), pick("language").alias("by_language"), pick("symbol_type").alias("by_symbol_type"))


def ingest_totals(results: DataFrame) -> DataFrame:
    """Sums of (files, chunks, indexed, failed) over repositories, and all errors in order."""
    return results.agg(*[F.sum(c).alias(c) for c in ("files", "chunks", "indexed", "failed")], F.array_sort(F.flatten(F.collect_list("errors"))).alias("errors"))


def file_chunks(chunks: DataFrame, repo: str, path: str, most: int = 1000) -> DataFrame:
    """The chunks of one file by first line, then id, with a fixed score."""
    own = chunks.where((F.col("repo") == repo) & (F.col("path") == path))
    return own.orderBy("start_line", "id").limit(most).withColumn("score", F.lit(1.0))
