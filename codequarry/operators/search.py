"""Filtered nearest-neighbour search over a vector column, exact and by an index of short codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.schema import RESULT_COLUMNS
from codequarry.session import cut

FILTERS = ("repo", "language", "microservice", "symbol_type")


def filtered(rows: DataFrame, filters: dict[str, str | None] | None) -> DataFrame:
    """Equal on every given filter; empty or missing ones are ignored. Comes before any ranking, so that the k best are the
    k best of what passes."""
    wanted = [F.col(k) == v for k, v in (filters or {}).items() if v]
    return rows.where(reduce(lambda a, b: a & b, wanted)) if wanted else rows


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine of a vector column with one query, in double precision. Null vectors and vectors without length give null."""
    q = np.asarray(query, float)
    literal = F.array(*[F.lit(float(x)) for x in q / max(float(np.linalg.norm(q)), 1e-300)])
    double = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(double, literal, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(double, F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot, norm)


def score(similarity: Column) -> Column:
    """A cosine as a score between 0 and 1."""
    return (similarity + 1) / 2


def top_k(rows: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one query, with `score`; ties by key. Each task keeps its k best, and the driver's merge is of
    those (TakeOrderedAndProject). Rows are ranked by the full cosine; only what is shown is rounded."""
    best = rows.withColumn("score", score(cosine(F.col(vector), query))).where("score is not null").orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("score", F.round("score", 6)).drop(vector)


def min_score(results: DataFrame, least: float) -> DataFrame:
    """What of a ranked result reaches a score; comes after the k best were taken."""
    return results.where(F.col("score") >= least)


def results(rows: DataFrame) -> DataFrame:
    return rows.select(*RESULT_COLUMNS)


def search(chunks: DataFrame, query: list[float], k: int = 20, filters: dict[str, str | None] | None = None) -> DataFrame:
    """The k best chunks that pass the filters, as result rows."""
    return results(top_k(filtered(chunks, filters), query, k))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(n, -1)


def _nearest(n_queries: int, k: int, similar):
    """Per task: for each query the k best rows of the task. `similar(column, rows)`: all queries against a batch."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = np.zeros((n_queries, 0), np.int64), np.zeros((n_queries, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            sims = np.round(similar(batch.column(1), batch.num_rows), 12)
            keys = np.broadcast_to(batch.column(0).to_numpy(), sims.shape)
            best, ids = np.concatenate([best, sims], axis=1), np.concatenate([ids, keys], axis=1)
            if best.shape[1] > k:
                order = np.lexsort((ids, -best), axis=1)[:, :k]
                best, ids = np.take_along_axis(best, order, 1), np.take_along_axis(ids, order, 1)
        if best.shape[1]:
            q = np.repeat(np.arange(n_queries), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids.ravel()), pa.array(best.ravel())], ["q", "neighbour", "cosine"])

    return scan


_FOUND = "q long, neighbour long, cosine double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(query, neighbour, rank, score): the k best of each query, ranked by the full cosine."""
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query", "neighbour", "rank", F.round(score(F.col("cosine")), 6).alias("score"))


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", vector: str = "embedding", block: int = 4096, index: "CodeIndex | None" = None) -> DataFrame:
    """(query, neighbour, rank, score): the k nearest rows of every query row, itself left out.

    Queries come in blocks of `block` vectors, each collected and broadcast by itself (the bound of what is sent); rows stay
    where they are, and only k rows per query and task are shuffled. Keys are whole numbers. With an index only its short codes are
    compared with all rows, and full vectors only for each query's shortlist.
    """
    spark, out = rows.sparkSession, None
    blocks = max(1, -(-queries.count() // block))
    own = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(key, vector).where(F.col(vector).isNotNull()).collect()
        if not part:
            continue
        q = _unit(np.array([r[1] for r in part], float))
        names = F.broadcast(spark.createDataFrame([(n, int(r[0])) for n, r in enumerate(part)], "q long, query long"))
        if index is None:
            near = own.mapInArrow(_nearest(len(q), k + 1, lambda column, n, q=q: q @ _unit(_matrix(column, n)).T), _FOUND).join(names, "q")
        else:
            near = index.search(q, names, k)
        near = near.where("query <> neighbour").select("query", "neighbour", "cosine")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], "query long, neighbour long, rank int, score double")
    return _ranked(out, k)


class CodeIndex:
    """Product quantisation: every vector is cut into parts of `part` numbers, and each part is named by its nearest of at most 256
    centroids, one byte. The centroids are fitted on at most `sample` vectors; every row gets its code. A search compares tables of
    the query's products with the centroids with all codes (a sixteenth of the vectors' bytes, without any product of vectors),
    keeps a shortlist of `shortlist` times k rows for each query, and computes cosines for those alone."""

    def __init__(self, rows: DataFrame, key: str = "id", vector: str = "embedding", part: int = 4, shortlist: int = 10, sample: int = 20_000, rounds: int = 10, seed: int = 7):
        own = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
        picked = own.orderBy(F.xxhash64("key")).limit(sample).collect()
        x = _unit(np.array([r[1] for r in picked], float).reshape(len(picked), -1)) if picked else np.zeros((1, part))
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % part)))
        rng, books = np.random.default_rng(seed), []
        for at in range(0, x.shape[1], part):
            piece = x[:, at : at + part]
            centres = piece[rng.choice(len(piece), min(256, len(piece)), replace=False)].copy()
            for _ in range(rounds):
                nearest = _nearest_centre(piece, centres)
                sums = np.zeros_like(centres)
                np.add.at(sums, nearest, piece)
                n = np.bincount(nearest, minlength=len(centres))[:, None]
                centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
            books.append(centres)
        self.books, self.part, self.shortlist, self.vectors = books, part, shortlist, own

        def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _unit(_matrix(batch.column(1), batch.num_rows)) if batch.num_rows else np.zeros((0, len(books) * part))
                v = np.pad(v, ((0, 0), (0, -v.shape[1] % part)))
                codes = np.stack([_nearest_centre(v[:, i * part : (i + 1) * part], c) for i, c in enumerate(books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["key", "code"])

        self.codes = cut(own.mapInArrow(encode, "key long, code binary"))  # written once, read by every search

    def search(self, queries: np.ndarray, names: DataFrame, k: int) -> DataFrame:
        """(q, query, neighbour, cosine) of the shortlists, with exact cosines."""
        queries = np.pad(queries, ((0, 0), (0, len(self.books) * self.part - queries.shape[1])))
        tables = [queries[:, i * self.part : (i + 1) * self.part] @ c.T for i, c in enumerate(self.books)]

        def similar(column: pa.Array, n: int) -> np.ndarray:
            codes = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)
            return sum(table[:, codes[:, i]] for i, table in enumerate(tables))

        most = self.shortlist * k
        near = self.codes.mapInArrow(_nearest(len(queries), most, similar), _FOUND)
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("cosine"), "neighbour"))
        listed = near.withColumn("rank", rank).where(F.col("rank") <= most).select("q", F.col("neighbour").alias("key"))
        exact = self.vectors.join(listed, "key").join(names, "q")

        def cosines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = _unit(_matrix(batch.column(3), batch.num_rows))
                    sims = np.einsum("ij,ij->i", queries[batch.column(0).to_numpy()][:, : v.shape[1]], v)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.round(sims, 12))], ["q", "query", "neighbour", "cosine"])

        return exact.select("q", "query", F.col("key").alias("neighbour"), "vector").mapInArrow(cosines, "q long, query long, neighbour long, cosine double")


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(recall): the share of exact neighbours that were found."""
    hit = exact.select("query", "neighbour").join(found.select("query", "neighbour").withColumn("hit", F.lit(1)), ["query", "neighbour"], "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))
