"""Problem 5: near-duplicate records with small edits.

`near_pairs` gives all pairs of rows whose sets of three-word runs overlap by at least 70 % (Jaccard) and that are not
copies but for layout; `near_groups` the groups they form; `near_classes` and `near_class_pairs` the same links without repeating
them for every copy: each row's class, and pairs of classes by their smallest ids.

How: one pass over the texts folds each set of word runs to MinHash samples, to band keys of four samples, and to an odd
sketch (the samples' parity bitmap, whose XOR population count estimates high similarities). Rows with equal sets are
one node from there on. Nodes that share a band key are candidates; first only the sketches of candidates travel and are XORed,
then the sets of runs of those pairs whose estimate is near the threshold or above, which are counted exactly. Band keys held by
more than `hot` nodes aren't paired within the key: their nodes go through an exact prefix join on rare runs, in which a run that very
many of them share is split into blocks of nodes that meet block by block, and the sketches are XORed inside the join; so a bucket of
a third of all rows loses no pair and emits only plausible ones. Pairs are found between nodes and only expanded to the rows (`id`)
at the end, with the rows of a large node spread over slots on both sides.

With 32 bands of 4 samples a pair at exactly 70 % is a candidate with probability 0.9998, above 75 % with 0.99999.

Defined cases: null texts and ids take no part; repeated rows of an id count once; texts under `least_words` words have
no pairs; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.functions.arrowtext import utf8_buffer, windows
from codequarry.llm.layout_copies import _mix, _NON_ASCII, _powers, layout_hashes, with_block_flag
from codequarry.operators.components import connected_components
from codequarry.session import cut, spread

RUN, LEAST_WORDS, THRESHOLD = 3, 30, 0.7
BANDS, ROWS, SKETCH_BITS = 32, 4, 512
SAMPLES = BANDS * ROWS

_rng = np.random.default_rng(20260102)
_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
WORD_WITHOUT_UNDERSCORE = _WORD & (np.arange(256) != 95)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(int(_rng.integers(2**62, 2**63)) | 1)
_MULTIPLIERS = _rng.integers(2**62, 2**63, size=SAMPLES, dtype=np.uint64) | np.uint64(1)
_SALTS = _rng.integers(1, 2**63, size=SAMPLES, dtype=np.uint64)


def _wide_words(match) -> str:
    return "".join(c if c.isalnum() else " " for c in match[0].lower())


def word_hashes(texts: pa.Array, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, and the row of each. `word`: the bytes that words are made of."""
    flat, offsets = utf8_buffer(texts)
    if flat.size and flat.max() >= 128:
        flat, offsets = utf8_buffer(pa.array([t if not t or t.isascii() else _NON_ASCII.sub(_wide_words, t) for t in texts.to_pylist()], pa.large_string()))
    all_hashes, all_rows = [], []
    for start, end in windows(offsets, 1 << 18):
        part = flat[offsets[start] : offsets[end]]
        if not part.size:
            continue
        cut_at = offsets[start + 1 : end] - offsets[start]
        inside = word[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut_at = cut_at[cut_at < part.size]
        first[cut_at] = inside[cut_at]  # a text's first byte begins a word whatever the text before ended with
        at = np.flatnonzero(first)
        if not at.size:
            continue
        number = np.cumsum(first) - 1
        place = np.arange(part.size) - at[np.maximum(number, 0)]
        place[~inside] = 0
        values = np.where(inside, _BYTE[part] * _powers(_BASE, int(place.max()) + 1)[place], np.uint64(0))
        all_hashes.append(_mix(np.add.reduceat(values, at)))
        all_rows.append(np.searchsorted(offsets, at + offsets[start], side="right") - 1)
    if not all_hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(all_hashes), np.concatenate(all_rows)


def run_sets(texts: pa.Array, run: int = RUN, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with enough words, the offsets of their sets, and the sets of hashed word runs end to end, each sorted."""
    words, rows = word_hashes(texts)
    enough = np.flatnonzero(np.bincount(rows, minlength=len(texts)) >= max(least_words, run))
    if not enough.size:
        return enough, np.zeros(1, np.int64), np.zeros(0, np.uint64)
    runs = words[: len(words) - run + 1].copy()
    for k in range(1, run):
        runs = _mix(runs * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - run + 1 + k])
    whole = (rows[: len(runs)] == rows[run - 1 :]) & np.isin(rows[: len(runs)], enough)
    runs, rows = runs[whole], rows[: len(runs)][whole]
    order = np.lexsort((runs, rows))
    runs, rows = runs[order], rows[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (rows[1:] != rows[:-1])
    runs, rows = runs[new], rows[new]
    return enough, np.searchsorted(rows, np.append(enough, len(texts))), runs


def min_samples(runs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash samples, shape (rows, SAMPLES)."""
    out = np.empty((len(offsets) - 1, SAMPLES), np.uint64)
    for j in range(SAMPLES):
        out[:, j] = np.minimum.reduceat((runs ^ _SALTS[j]) * _MULTIPLIERS[j] >> np.uint64(20), offsets[:-1])
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of each row's samples as 64-bit words, shape (rows, SKETCH_BITS / 64)."""
    bits = (_mix(samples + _SALTS) >> np.uint64(3)).astype(np.int64) % SKETCH_BITS
    bits += np.arange(len(samples))[:, None] * SKETCH_BITS
    odd = np.bincount(bits.ravel(), minlength=len(samples) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(samples), -1)


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(samples), BANDS)).copy()
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, k::ROWS])
    return key.view(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, _block) to (id, h1, h2, s, bands, sketch, runs)."""
    for batch in batches:
        rows, offsets, runs = run_sets(batch.column(1))
        if not rows.size:
            continue
        taken = batch.take(pa.array(rows))
        h = layout_hashes(taken.column(1), taken.column(2).to_numpy(zero_copy_only=False).astype(bool)).view(np.int64)
        samples = min_samples(runs, offsets)
        node = _mix(np.add.reduceat(_mix(runs + np.uint64(11)), offsets[:-1])).view(np.int64)
        bands, sketches = band_keys(samples), odd_sketches(samples)
        n = np.arange(len(rows) + 1)
        yield pa.RecordBatch.from_arrays(
            [taken.column(0), pa.array(h[0]), pa.array(h[1]), pa.array(node), _lists(bands.ravel(), n * BANDS, pa.int64()),
             _lists(sketches.ravel(), n * sketches.shape[1], pa.int64()), _lists((runs >> np.uint64(32)).astype(np.uint32).view(np.int32), offsets, pa.int32())],
            ["id", "h1", "h2", "s", "bands", "sketch", "runs"],
        )


SIGNED = "id string, h1 long, h2 long, s long, bands array<long>, sketch array<long>, runs array<int>"


def sketch_similarity(odd_bits: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of odd bits in the XOR of two sketches of SAMPLES samples."""
    share = np.minimum(2 * odd_bits / SKETCH_BITS, 0.999)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log1p(-share)


def most_odd_bits(threshold: float) -> int:
    """The most odd bits of a pair that may reach the threshold: three standard errors of the MinHash samples and the sketch's own
    below it, so that the sketch alone rejects nothing nearer."""
    floor = threshold - 3 * math.sqrt(threshold * (1 - threshold) / SAMPLES) - 0.05
    return int(np.flatnonzero(sketch_similarity(np.arange(SKETCH_BITS // 2)) >= floor).max())


def _odd_bits(a: str, b: str) -> Column:
    """The population count of the XOR of two sketch columns."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))


def _compared(threshold: float):
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, runs_a, runs_b) to the (a, b) whose sets overlap enough."""
        for batch in batches:
            keep = []
            a, b = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= threshold * (len(x) + len(y) - common) - 1e-9:
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return compare


def _rare_run_pairs(nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """Exact candidates among nodes of hot band keys: two sets above the threshold share a run among each other's
    rarest n - ceil(threshold * n) + 1 runs. A run that more than `block` nodes share is split into parts of about `block` nodes, and
    each two parts meet in a group of their own."""
    runs = cut(nodes.select("s", F.size("runs").alias("n"), F.explode("runs").alias("r")))
    df = runs.groupBy("r").agg(F.count("*").alias("df")).where("df > 1")
    order = W.partitionBy("s").orderBy("df", "r")
    rare = runs.join(df, "r", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("k", F.row_number().over(order))
    rare = rare.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1")
    parts = F.ceil(F.col("df") / block).cast("int")
    rare = cut(rare.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")).join(nodes.select("s", "sketch"), "s").select("r", "s", "n", "sketch", "parts", "part"))
    # part i as the left side of (i, j) for all j >= i, and as the right side of (j, i) for all j <= i
    left = rare.withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1))).select("r", "part", "other", "s", "n", "sketch")
    right = rare.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("part")))).select("r", F.col("first").alias("part"), F.col("part").alias("other"), F.col("s").alias("t"), F.col("n").alias("m"), F.col("sketch").alias("sketch_t"))
    near = (F.col("n") >= threshold * F.col("m")) & (F.col("m") >= threshold * F.col("n"))
    # within one part each pair comes in both orders, between two parts in one
    once = (F.col("part") != F.col("other")) | (F.col("s") < F.col("t"))
    close = left.join(right, ["r", "part", "other"]).where(once & (F.col("s") != F.col("t")) & near & (_odd_bits("sketch", "sketch_t") <= most_odd_bits(threshold)))
    return close.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def _node_pairs(signed: DataFrame, threshold: float, hot: int) -> DataFrame:
    # copies of a node repeat its keys; they are combined before the shuffle, and only make a key look hotter than it is
    keys = signed.select("s", F.explode("bands").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b"))
    held = cut(keys.join(shared.where("n > 2").select("key", "n"), "key").distinct())
    few = held.where(F.col("n") <= hot).select("key", "s")
    pairs = shared.where("n = 2").select("a", "b").unionByName(
        few.select("key", F.col("s").alias("a")).join(few.select("key", F.col("s").alias("b")), "key").where("a < b").select("a", "b")
    )
    crowded = held.where(F.col("n") > hot).select("s").distinct()
    nodes = cut(signed.select("s", "runs", "sketch").join(crowded, "s", "left_semi").dropDuplicates(["s"]))
    pairs = cut(pairs.unionByName(_rare_run_pairs(nodes, threshold, hot)).distinct())

    def both(of: DataFrame, column: str) -> DataFrame:
        """The pairs with a column of each of their nodes; only nodes in a pair send theirs."""
        ends = of.select(F.explode(F.array("a", "b")).alias("s")).distinct()
        facts = signed.select("s", column).join(ends, "s", "left_semi").dropDuplicates(["s"])
        side = lambda end: facts.select(F.col("s").alias(end), F.col(column).alias(f"{column}_{end}"))
        return of.join(side("a"), "a").join(side("b"), "b").select("a", "b", f"{column}_a", f"{column}_b")

    likely = cut(both(pairs, "sketch").where(_odd_bits("sketch_a", "sketch_b") <= most_odd_bits(threshold)).select("a", "b"))
    return both(likely, "runs").mapInArrow(_compared(threshold), "a long, b long")


def _found(chunks: DataFrame, threshold: float, hot: int) -> tuple[DataFrame, DataFrame]:
    rows = with_block_flag(chunks.where("id is not null and text is not null")).select("id", "text", "_block")
    signed = cut(spread(rows).mapInArrow(_signed, SIGNED))
    return signed.select("s", "id", "h1", "h2").distinct(), cut(_node_pairs(signed, threshold, hot))


def _several(members: DataFrame) -> DataFrame:
    """(s): nodes of texts that differ in more than layout although their sets of runs are equal."""
    return members.groupBy("s").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("s")


def _expanded(nodes: DataFrame, members: DataFrame, slot_rows: int) -> DataFrame:
    """(id_a, h1_a, h2_a, id_b, h1_b, h2_b) of all rows of the two nodes of each pair. The rows of a node with more than `slot_rows` are
    spread over slots, on both sides, so that no task holds more than a slot of each at a time."""
    sizes = members.groupBy("s").agg(F.ceil(F.count("*") / slot_rows).cast("int").alias("slots"))
    slotted = cut(members.join(sizes, "s").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int")).drop("slots"))
    out = nodes
    for end in ("a", "b"):
        named = sizes.select(F.col("s").alias(end), "slots")
        side = slotted.select(F.col("s").alias(end), "slot", *[F.col(c).alias(f"{c}_{end}") for c in ("id", "h1", "h2")])
        out = out.join(named, end).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots").join(side, [end, "slot"]).drop("slot")
    return out


def near_pairs(chunks: DataFrame, threshold: float = THRESHOLD, hot: int = 300, slot_rows: int = 1000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs at or above the threshold that are not copies but for layout."""
    members, pairs = _found(chunks, threshold, hot)
    members = cut(members)
    # equal sets of runs are pairs too, unless the texts are layout copies
    nodes = pairs.unionByName(_several(members).select(F.col("s").alias("a"), F.col("s").alias("b")))
    both = _expanded(nodes, members, slot_rows).where("h1_a <> h1_b or h2_a <> h2_b")
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).where("id_a < id_b").distinct()


def near_classes(chunks: DataFrame) -> DataFrame:
    """(id, class_id): each row with enough words and the smallest id of its class, the rows that are copies but for layout and have the
    same runs. With `near_class_pairs` it holds all links, in as many rows as there are texts and links between different ones."""
    rows = with_block_flag(chunks.where("id is not null and text is not null")).select("id", "text", "_block")
    members = spread(rows).mapInArrow(_signed, SIGNED).select("s", "id", "h1", "h2").distinct()
    return _classes(cut(members)).select("id", "class_id")


def _classes(members: DataFrame) -> DataFrame:
    least = members.groupBy("s", "h1", "h2").agg(F.min("id").alias("class_id"))
    return members.join(least, ["s", "h1", "h2"])


def near_class_pairs(chunks: DataFrame, threshold: float = THRESHOLD, hot: int = 300, slot_rows: int = 1000) -> DataFrame:
    """(class_a, class_b), class_a < class_b: the pairs of classes at or above the threshold."""
    members, pairs = _found(chunks, threshold, hot)
    classes = cut(_classes(cut(members)).select("s", F.col("class_id").alias("id"), "h1", "h2").distinct())
    nodes = pairs.unionByName(_several(classes).select(F.col("s").alias("a"), F.col("s").alias("b")))
    both = _expanded(nodes, classes, slot_rows).where("h1_a <> h1_b or h2_a <> h2_b")
    return both.select(F.least("id_a", "id_b").alias("class_a"), F.greatest("id_a", "id_b").alias("class_b")).where("class_a < class_b").distinct()


def near_groups(chunks: DataFrame, threshold: float = THRESHOLD, hot: int = 300) -> DataFrame:
    """(id, group_id, links): every row of a group of two or more different texts; `group_id` is the group's smallest
    id, `links` the number of other run sets that the row's own is linked with."""
    members, pairs = _found(chunks, threshold, hot)
    members = cut(members)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.groupBy(F.col("a").alias("s")).agg(F.count("*").alias("links"))
    linked = connected_components(pairs).withColumnRenamed("node", "s")
    # different texts of one set of runs are a group of their own where no other set is near
    alone = _several(members).join(linked, "s", "left_anti")
    parts = cut(linked.unionByName(alone.select("s", F.col("s").alias("component"))))
    least = members.groupBy("s").agg(F.min("id").alias("least"))
    names = parts.join(least, "s").groupBy("component").agg(F.min("least").alias("group_id"))
    return members.join(parts, "s").join(names, "component").join(links, "s", "left").select("id", "group_id", F.coalesce("links", F.lit(0)).alias("links")).distinct()
