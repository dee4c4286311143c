"""Incremental ingestion as a stream of delivered files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    """Files (repo, relative_path, content, committed_at, scanned_at, ...) as they are delivered to a directory of Parquet."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_deliveries(files: DataFrame, late: str = "90 days") -> DataFrame:
    """Each file id once within the watermark: a second delivery is dropped, and the state of older ids is let go."""
    return files.withWatermark("scanned_at", late).dropDuplicatesWithinWatermark(["file_id"])


def scans_by_window(files: DataFrame, late: str = "90 days", window: str = "7 days") -> DataFrame:
    """(start, repo, files, bytes): deliveries per window of scan time and repository, final once the watermark has passed."""
    return (
        files.withWatermark("scanned_at", late)
        .groupBy(F.window("scanned_at", window), "repo")
        .agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"))
        .select(F.col("window.start").alias("start"), "repo", "files", "bytes")
    )


def upsert_stream(chunks: DataFrame, write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hand every batch of chunks to an idempotent write by id; a repeated batch after a failure changes nothing."""
    return chunks.writeStream.foreachBatch(lambda batch, _: write(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
