"""The chunk table on disk: Parquet, one partition per repository."""

from __future__ import annotations

import dataclasses as D
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.schema import CODE_CHUNK
from codequarry.session import cut


def latest(rows: DataFrame, key: str = "id", order: list[str] = ("indexed_at",), columns: list[str] | None = None) -> DataFrame:
    """The last delivery of each key; ties by the remaining columns of `order`. The last row is found by an aggregate that
    combines before the shuffle, so a key delivered very often is no burden. Only `columns` (all, if none are named), the key and
    `order` are read and shuffled: name what is needed, and for a tie among texts order by a digest."""
    rest = [c for c in (rows.columns if columns is None else columns) if c != key]
    if not rest:
        return rows.select(key).distinct()
    newest = rows.select(*dict.fromkeys([key, *order, *rest])).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(key, "_row.*").select(*(rows.columns if columns is None else dict.fromkeys([key, *rest])))


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """`new` in place of the rows of `old` with the same key, plus all others."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def reindexed(old: DataFrame, new: DataFrame, repo: str) -> DataFrame:
    """All of a repository's rows replaced by `new`, which may be empty."""
    return old.where(~F.col("repo").eqNullSafe(repo)).unionByName(new)


SHOWN_ERRORS = 10


@D.dataclass
class Upserted:
    """What an upsert stored, what it could not store, and the first reasons."""

    indexed: int
    failed: int
    errors: list[str]


class ChunkStore:
    """Create, replace and drop. Replacing a repository is one commit of its partition, so a reader sees the old or the new
    rows, never neither."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self) -> bool:
        fs, path = self._fs()
        return bool(fs.exists(path))

    def ping(self) -> bool:
        """Whether the table is there and can be read."""
        try:
            return self.exists() and self.read().limit(1).count() >= 0
        except Exception:
            return False

    def create(self, force: bool = False) -> bool:
        """True if the table was made anew."""
        if self.exists() and not force:
            return False
        self.drop()
        fs, path = self._fs()
        fs.mkdirs(path)
        return True

    def drop(self) -> None:
        fs, path = self._fs()
        if fs.exists(path):
            fs.delete(path, True)

    def read(self, embedding: bool = False) -> DataFrame:
        rows = self.spark.read.schema(CODE_CHUNK).parquet(self.path)
        return rows if embedding else rows.drop("embedding")

    def replace(self, chunks: DataFrame) -> None:
        """Each repository in `chunks` replaces its partition; others stay."""
        ready = chunks.select(*CODE_CHUNK.names)
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(self.path)

    def upsert(self, chunks: DataFrame, order: list[str] = ()) -> Upserted:
        """Rows by id; only partitions of the repositories concerned are written. Of several rows of an id the last by `order` (columns
        of `chunks`, as a table has no order of its own) wins; without one, the greatest by all columns, so that a repeated run
        gives the same. Rows without id or repository can't be stored: they are counted and the first of them named."""
        usable = F.col("id").isNotNull() & F.col("repo").isNotNull()
        bad = cut(chunks.where(~usable).select("id", "repo", "path"))
        errors = [f"{r['repo']}/{r['path']}: no {'id' if r['id'] is None else 'repository'}" for r in bad.limit(SHOWN_ERRORS).collect()]
        columns = [c for c in CODE_CHUNK.names if c not in order]
        new = cut(latest(chunks.where(usable), "id", [*order, *(c for c in columns if c != "id")], list(CODE_CHUNK.names)))
        touched = [r[0] for r in new.select("repo").distinct().collect()]  # repositories, not rows
        if touched:
            old = self.read(embedding=True).where(F.col("repo").isin(touched))
            self.replace(cut(upserted(old, new)))
        return Upserted(new.count(), bad.count(), errors)

    def delete_repo(self, repo: str) -> int:
        """The number of deleted rows. The partition's directory is first moved aside in one step, under a name that readers skip: they
        see all of the repository's rows or none."""
        own = self.read().where(F.col("repo") == repo)
        n = own.count()
        if n:
            fs, root = self._fs()
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            place = path(unquote(own.select(F.input_file_name()).first()[0])).getParent()
            aside = path(root, f"_deleted-{uuid.uuid4().hex}")
            if fs.rename(place, aside):
                fs.delete(aside, True)
            self.spark.catalog.refreshByPath(self.path)
        return n


def new_or_changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (repo, relative_path, digest of the content) isn't known yet: what an incremental run has to read."""
    digest = F.sha2(F.coalesce("content", F.lit("")), 256)
    return files.withColumn("digest", digest).join(known.select("repo", "relative_path", "digest"), ["repo", "relative_path", "digest"], "left_anti")


def removed(files: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(files.select("repo", "relative_path"), ["repo", "relative_path"], "left_anti").select("repo", "relative_path")


def numbered_parts(chunks: DataFrame) -> DataFrame:
    """`part` of each chunk within its file, by first line and id."""
    return chunks.withColumn("part", F.row_number().over(W.partitionBy("repo", "path").orderBy("start_line", "id")))
