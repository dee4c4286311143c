"""Repositories under a root directory."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.globs import matches_names
from codequarry.schema import REPOSITORY

log = logging.getLogger(__name__)


def _head(git: str) -> tuple[str, str]:
    """(branch, commit) from `.git`; a detached head counts as `main`."""
    with open(os.path.join(git, "HEAD"), encoding="utf-8") as f:
        head = f.read().strip()
    if not head.startswith("ref: "):
        return "main", head
    ref = head[5:]
    loose = os.path.join(git, ref)
    if os.path.exists(loose):
        with open(loose, encoding="utf-8") as f:
            return ref.removeprefix("refs/heads/"), f.read().strip()
    packed = os.path.join(git, "packed-refs")
    if os.path.exists(packed):
        with open(packed, encoding="utf-8") as f:
            for line in f:
                if line.rstrip().endswith(" " + ref):
                    return ref.removeprefix("refs/heads/"), line.split()[0]
    raise FileNotFoundError(f"no commit for {ref}")


def repository(root: str, name: str) -> tuple | None:
    """(name, path, branch, commit) of one directory; None if it is no repository or its metadata can't be read. A `.git`
    file (a worktree or submodule) is no repository."""
    path = os.path.join(root, name)
    git = os.path.join(path, ".git")
    if not os.path.isdir(git):
        return None
    try:
        return (name, path, *_head(git))
    except OSError as e:
        log.warning("skipped repository %s: %s", name, e)
        return None


def discover(spark: SparkSession, root: str, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """All repositories directly under `root` whose names pass the patterns."""
    names = sorted(e.name for e in os.scandir(root) if e.is_dir())
    rows = [r for r in (repository(root, n) for n in names) if r]
    found = spark.createDataFrame([(*r, None, None) for r in rows], REPOSITORY)
    return found.where(matches_names(F.col("name"), include, exclude))


def with_overrides(repositories: DataFrame, overrides: DataFrame, name: str = "name") -> DataFrame:
    """Microservice and tags from an override table (name, microservice, tags); repositories without an entry keep nulls.
    The override table has one row per repository."""
    own = overrides.select(F.col(name).alias("_name"), F.col("microservice").alias("_service"), F.col("tags").alias("_tags"))
    kept = repositories.drop("microservice", "tags")
    return kept.join(own, kept[name] == own["_name"], "left").drop("_name").withColumnsRenamed({"_service": "microservice", "_tags": "tags"})
