"""Files of repositories, read by Spark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.globs import ignore_globs, matches_paths
from codequarry.functions.languages import language_of
from codequarry.functions.text import extension, readable


def ignore_rules(repo_path: str) -> list[str]:
    """The lines of the ignore file at the repository's root."""
    path = os.path.join(repo_path, ".gitignore")
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read().splitlines()


def enumerate_files(spark: SparkSession, repo_path: str, include: list[str], exclude: list[str] = (), use_gitignore: bool = True) -> DataFrame:
    """(absolute_path, relative_path, language, extension, content): the files of a known language that pass the patterns.
    Contents are read where they are used: without that column only the listing is."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(repo_path)
    absolute = F.regexp_replace("path", "^[a-z]+:(?://)?", "")
    prefix = os.path.abspath(repo_path).rstrip("/") + "/"
    files = listed.withColumn("absolute_path", absolute).withColumn("relative_path", F.expr(f"substring(absolute_path, {len(prefix) + 1})"))
    ignored = ignore_globs(ignore_rules(repo_path)) if use_gitignore else []
    return _known(files, include, [*exclude, *ignored]).select("absolute_path", "relative_path", "language", "extension", readable(F.col("content")).alias("content"))


def enumerate_repositories(spark: SparkSession, repositories: list[tuple[str, str]], include: list[str], exclude: list[str] = (), use_gitignore: bool = True) -> DataFrame | None:
    """The files of several repositories, with their name in `repo`. Repositories under one parent directory with the same ignore
    rules are one scan, whatever their number; there are as many scans as different sets of rules."""
    alike: dict[tuple, list[tuple[str, str]]] = {}
    for name, path in repositories:
        rules = tuple(ignore_rules(path)) if use_gitignore else ()
        alike.setdefault((os.path.dirname(os.path.abspath(path)), rules), []).append((name, os.path.basename(os.path.abspath(path))))
    out = None
    for (parent, rules), own in alike.items():
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{parent}/{folder}" for _, folder in own])
        files = listed.withColumn("absolute_path", F.regexp_replace("path", "^[a-z]+:(?://)?", ""))
        below = F.substring(F.col("absolute_path"), len(parent.rstrip("/")) + 2, 1 << 30)
        names = F.create_map(*[F.lit(x) for name, folder in own for x in (folder, name)])
        files = files.withColumn("repo", F.element_at(names, F.substring_index(below, "/", 1))).withColumn("relative_path", F.regexp_replace(below, "^[^/]*/", ""))
        found = _known(files, include, [*exclude, *ignore_globs(list(rules))]).select("absolute_path", "relative_path", "language", "extension", readable(F.col("content")).alias("content"), "repo")
        out = found if out is None else out.unionByName(found)
    return out


def _known(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """The files of a known language that pass the patterns, with `extension` and `language`."""
    passed = files.where(matches_paths(F.col("relative_path"), include, exclude)).withColumn("extension", extension(F.col("relative_path")))
    return passed.withColumn("language", language_of(F.col("extension"))).where("language <> 'unknown'")


def read_file(spark: SparkSession, repo_path: str, relative_path: str) -> str:
    """The text of one file of a repository."""
    row = spark.read.format("binaryFile").load(f"{repo_path.rstrip('/')}/{relative_path}").select(readable(F.col("content")).alias("content")).first()
    return row["content"]
