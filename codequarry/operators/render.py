"""Result tables as text, one row each, by Spark expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import score_text
from codequarry.operators.rag import ranked


def _joined(parts: DataFrame, order: str, part: str, separator: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, part))), lambda x: x[part])
    return parts.agg(F.array_join(listed, separator).alias("body"), F.count("*").alias("n"))


def search_text(results: DataFrame) -> DataFrame:
    """(text): numbered results with place, score and fenced code."""
    head = F.concat(F.lit("Result "), F.col("rank").cast("string"), F.lit(" (score: "), score_text(F.col("score")), F.lit(")\n"), "repo", F.lit("/"), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    facts = F.concat_ws("\n", head, F.concat(F.lit("Symbol: "), "symbol_name"), F.concat(F.lit("Signature: "), "signature"))
    body = F.concat(facts, F.lit("\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), "text", F.lit("\n```"))
    out = _joined(ranked(results).select("rank", body.alias("part")), "rank", "part", "\n\n")
    return out.select(F.when(F.col("n") > 0, F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" results\n\n"), "body")).otherwise("No matching code found").alias("text"))


def repositories_text(listed: DataFrame) -> DataFrame:
    """(text) of `list_repositories`."""
    rows = listed.select((-F.col("chunks")).alias("o"), "repo").select(F.struct("o", "repo").alias("o"), F.concat(F.lit("- "), "repo").alias("part"))
    out = _joined(rows, "o", "part", "\n")
    return out.select(F.when(F.col("n") > 0, F.concat(F.lit("Indexed repositories ("), F.col("n").cast("string"), F.lit(")\n"), "body")).otherwise("Nothing is indexed yet").alias("text"))


def stats_text(stats: DataFrame) -> DataFrame:
    """(repo, text): one text per repository from the long form of its counts."""
    line = F.concat(F.lit("- "), "value", F.lit(": "), F.col("chunks").cast("string"))
    rows = stats.select("repo", "facet", "chunks", F.struct((-F.col("chunks")).alias("n"), "value", line.alias("line")).alias("o"))
    listed = lambda facet: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("facet") == facet, F.col("o")))), lambda x: x["line"]), "\n")
    total = F.coalesce(F.sum(F.when(F.col("facet") == "total", F.col("chunks"))), F.lit(0))
    each = rows.groupBy("repo").agg(total.alias("total"), listed("language").alias("languages"), listed("symbol_type").alias("symbols"))
    return each.select("repo", F.concat(F.lit("Total chunks: "), F.col("total").cast("string"), F.lit("\nBy language:\n"), "languages", F.lit("\nBy symbol type:\n"), "symbols").alias("text"))


def file_chunks_text(chunks: DataFrame) -> DataFrame:
    """(text) of one file's chunks in their order."""
    title = F.concat(F.lit("## "), F.coalesce("symbol_name", "symbol_type"), F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), "text", F.lit("\n```"))
    out = _joined(chunks.select(F.struct("start_line", "id").alias("o"), title.alias("part")), "o", "part", "\n\n")
    return out.select(F.when(F.col("n") > 0, F.col("body")).otherwise("No chunks found").alias("text"))
