"""Problem 7: filling containers of fixed capacity with documents.

`packed` assigns every document, sized in tokens of a public tokenizer, to containers of a given capacity with little room
lost; only documents longer than the capacity are cut, into pieces of the capacity and a rest.

How: bulk-synchronous best-fit. Documents of one size form a class (size, first rank, number), containers with one gap a range (gap,
first container, number), and both are rows of one table that Spark range-partitions by size and gap. A round is one Spark job
over that table: in every range a successor sweep goes upwards through sizes and gaps, and each gap takes the largest documents
that fit it and that no tighter gap has taken (as many copies as fit, if the class has enough for all containers of the
range); what a range could not match is carried to the sweep of all ranges together. Conflicts are resolved by rank: the i-th
document of a class takes the i-th container of the range. Then gaps are updated and the next round begins; documents that are
larger than every gap open containers. Only a few sums reach the driver between rounds. The rows are at most the capacity (sizes) plus
the containers' ranges, of which a round adds at most one per class, whatever the number of documents; the documents themselves are
ranked within their size class where they lie and look their container up by an equi-join on blocks of ranks. Nothing is sorted,
broadcast or collected whole, and a size that a third of all documents share is ranked and joined block by block.

Defined cases: null or empty texts have no tokens and are put into container 0; repeated rows of a document count once,
with their largest size; a null id is left out.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.session import cut, spread

CAPACITY = 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the tokenizer's split pattern
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sized(path: str):
    def size(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) to (doc_id, n)."""
        encoding = _encoding(path)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n"])

    return size


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n): tokens of every document."""
    own = documents.where("doc_id is not null").select("doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    return spread(own).mapInArrow(_sized(tokenizer), f"doc_id {kind}, n long").groupBy("doc_id").agg(F.max("n").alias("n"))


def _ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, piece, tokens) to the same with the partition's number and the row's rank in its size class there."""
    part, seen = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        sizes = batch.column(2).to_numpy()
        order = np.argsort(sizes, kind="stable")
        values, starts, counts = np.unique(sizes[order], return_index=True, return_counts=True)
        ranks = np.empty(len(sizes), np.int64)
        ranks[order] = np.arange(len(sizes)) - np.repeat(starts, counts) + np.repeat([seen[v] for v in values.tolist()], counts)
        for v, n in zip(values.tolist(), counts.tolist(), strict=True):
            seen[v] += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(sizes), pa.int32()), pa.array(ranks)], ["doc_id", "piece", "tokens", "part", "local"])


Run = tuple[int, int, int]  # (size or gap, first rank or container, number)
Match = tuple[int, int, int, int, int, int]  # (gap that is left, first container, containers, size, first rank, copies in each)


def sweep(items: list[Run], gaps: list[Run]) -> tuple[list[Run], list[Run], list[Match]]:
    """One successor sweep: (documents left, gaps left, matches). Sizes and gaps go upwards together; a gap takes the largest documents
    below it that are still there, so each document is taken by the tightest gap that comes its way."""
    items, gaps = sorted(items), sorted(gaps)
    below: list[Run] = []
    left, matches, at = [], [], 0
    for gap, first, n in gaps:
        while at < len(items) and items[at][0] <= gap:
            below.append(items[at])
            at += 1
        while n and below:
            size, rank, m = below.pop()
            taken = min(n, m)
            copies = min(gap // size, m // n) if m >= n else 1
            matches.append((gap - copies * size, first, taken, size, rank, copies))
            if m > taken * copies:
                below.append((size, rank + taken * copies, m - taken * copies))
            first, n = first + taken, n - taken
        if n:
            left.append((gap, first, n))
    return below + items[at:], left, matches


STATE = "kind string, value long, first long, n long, size long, rank long, copies long"


def swept(items: list[Run], gaps: list[Run], inside: Callable[[int], bool]) -> tuple[list[Run], list[Run], list[Match]]:
    """Sweeps over one range until none of its gaps takes a document of it any more. A gap that is left by a match and still lies inside
    the range is swept again; the match then keeps nothing (0)."""
    matches: list[Match] = []
    waiting: list[Run] = []
    while gaps and items:
        items, left, found = sweep(items, gaps)
        waiting += left
        again = [m for m in found if m[0] and inside(m[0])]
        matches += [m for m in found if not (m[0] and inside(m[0]))] + [(0, *m[1:]) for m in again]
        gaps = [m[:3] for m in again]
    return items, waiting + gaps, matches


def _sweeps(capacity: int, ranges: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def sweep_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Sweeps over the `item` and `gap` rows of a range (-1: what ranges carry on, swept once); all other rows pass."""
        runs = {kind: list(own[["value", "first", "n"]].itertuples(index=False, name=None)) for kind, own in rows.groupby("kind")}
        items, gaps, matches = swept(runs.get("item", []), runs.get("gap", []), lambda v: (v - 1) * ranges // capacity == key[0])
        new = [("item", *x, 0, 0, 0) for x in items] + [("gap", *x, 0, 0, 0) for x in gaps] + [("match", *x) for x in matches]
        out = pd.DataFrame(new, columns=["kind", "value", "first", "n", "size", "rank", "copies"])
        kept = rows.loc[rows["kind"] == "match", out.columns]
        return pd.concat([kept, out], ignore_index=True) if len(kept) and len(out) else kept if len(kept) else out

    return sweep_group


def needed(sizes: DataFrame, capacity: int) -> int:
    """The least number of containers that documents of these classes (value, n) need for themselves."""
    half = F.sum(F.when(F.col("value") * 2 > capacity, F.col("n")).otherwise(0))
    row = sizes.agg(F.sum(F.col("value") * F.col("n")).alias("tokens"), half.alias("large")).first()
    return max(-(-int(row["tokens"] or 0) // capacity), int(row["large"] or 0))


def best_fit(classes: DataFrame, capacity: int, ranges: int = 8) -> DataFrame:
    """The rounds: (size, rank, total, first, n), where document `rank + i` of a size goes to container `first + i % n`, i below
    `total`. `classes`: (value, n), the documents of each size from 1 to the capacity."""
    spark, sweeps = classes.sparkSession, _sweeps(capacity, ranges)
    items = cut(classes.select(F.lit("item").alias("kind"), F.col("value").cast("long"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long"), *[F.lit(0).cast("long").alias(c) for c in ("size", "rank", "copies")]))
    empty = spark.createDataFrame([], STATE)
    gaps, plan, containers = empty, empty, 0
    opening = needed(items, capacity)
    while opening:
        fresh = spark.createDataFrame([("gap", capacity, containers, opening, 0, 0, 0)], STATE)
        containers += opening
        state = items.unionByName(gaps).unionByName(fresh)
        opening = 0
        while not opening:
            local = F.floor((F.col("value") - 1) * ranges / capacity)
            here = state.withColumn("range", local).groupBy("range").applyInPandas(sweeps, STATE)
            # carries meet in one sweep; matches that are made already stay spread
            carried = here.withColumn("range", F.when(F.col("kind") == "match", F.pmod(F.xxhash64("first"), F.lit(ranges))).otherwise(-1))
            after = cut(carried.groupBy("range").applyInPandas(sweeps, STATE))
            found = after.where("kind = 'match'")
            plan = plan.unionByName(found)
            items = after.where("kind = 'item'")
            gaps = after.where("kind <> 'item' and value > 0").select(F.lit("gap").alias("kind"), "value", "first", "n", *[F.lit(0).cast("long").alias(c) for c in ("size", "rank", "copies")])
            sums = after.agg(F.max(F.when(F.col("kind") != "item", F.col("value"))).alias("widest"), F.count(F.when(F.col("kind") == "item", 1)).alias("left"), F.max(F.when(F.col("kind") == "item", F.col("value"))).alias("largest")).first()
            if not sums["left"]:
                break
            if sums["largest"] > (sums["widest"] or 0):
                opening = needed(items.where(F.col("value") > (sums["widest"] or 0)), capacity)
            state = items.unionByName(gaps)
    return plan.select("size", "rank", (F.col("n") * F.col("copies")).alias("total"), "first", "n")


RANK_BLOCK = 4096  # ranks of one size that meet their containers in one group of the join


def packed(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, first_token, tokens, container): every piece of every document; the pieces of a document no longer than
    the capacity are one."""
    sizes = token_sizes(documents, tokenizer)
    pieces = sizes.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / capacity).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("tokens"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    ranked = cut(pieces.mapInArrow(_ranked, f"doc_id {kind}, piece int, tokens int, part int, local long"))
    each = cut(ranked.groupBy("tokens", "part").agg(F.count("*").alias("n")))
    before = W.partitionBy("tokens").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = each.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    plan = best_fit(each.where("tokens > 0").groupBy(F.col("tokens").alias("value")).agg(F.sum("n").alias("n")), capacity)
    block = lambda c: F.floor(c / RANK_BLOCK)
    plan = plan.withColumn("block", F.explode(F.sequence(block(F.col("rank")), block(F.col("rank") + F.col("total") - 1)))).withColumnsRenamed({"size": "tokens", "rank": "start"})
    ready = ranked.join(offsets, ["tokens", "part"]).select("doc_id", "piece", "tokens", (F.col("before") + F.col("local")).alias("rank")).withColumn("block", block(F.col("rank")))
    inside = (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("total"))
    placed = ready.where("tokens > 0").join(plan, ["tokens", "block"]).where(inside).withColumn("container", F.col("first") + (F.col("rank") - F.col("start")) % F.col("n"))
    out = ["doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), "tokens"]
    return placed.select(*out, "container").unionByName(ready.where("tokens = 0").select(*out, F.lit(0).cast("long").alias("container")))


def container_fill(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, documents, tokens, room): how full each container is."""
    return packed(documents, capacity, tokenizer).groupBy("container").agg(
        F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), (F.lit(capacity) - F.sum("tokens")).alias("room")
    )
