"""Problem 8: evaluation texts that leaked into training documents.

`leaked_items` gives every (document, item) in which the document holds at least 12 consecutive words of the item;
`leak_overlap` says how much of the item's questions and of its answers, each by itself, the document holds.

How: a BM25 inverted index over the test items, with pairs of neighbouring words as terms, is computed by Spark: document
frequencies, weights, and for each item the threshold, the least score that any 12 consecutive words of the item have against
the item itself. Statistics are those of all items. What a worker gets is one block of items at a time, bounded in bytes: its
postings, in blocks of 16 with their greatest weights, are broadcast, all documents are scanned, the pairs are written and the broadcast
is destroyed before the next block. Every document is cut into passages of 24 words, 12 words apart, so that any 12
consecutive words lie whole in one of them; each passage is a query. Passages whose terms' greatest weights together stay below all
thresholds are left out at once; the others are answered by block-max WAND. As BM25 weights are never negative, no passage that holds
such words can stay below the item's threshold, so retrieval loses nothing; what it retrieves is then verified word by
word. Documents are scanned where they lie; only ids and items are emitted.

Defined cases: null texts or ids take no part; items under 12 words cannot leak; repeated rows count once; words are the
longest sequences of letters and digits, in lower case; a text without a question mark is all answer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.llm.near_copies import WORD_WITHOUT_UNDERSCORE, _mix, word_hashes
from codequarry.operators.skew import hot_keys, salted_join
from codequarry.session import cut, spread

LEAST_RUN, TERM, PASSAGE, STRIDE = 12, 2, 24, 12
K1, B, BLOCK = 1.2, 0.75, 16
BLOCK_BYTES = 16 << 20  # text of the items of one broadcast index, which takes about five times as much

_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return out


def _term_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) to (item_id, pos, term)."""
    for batch in batches:
        hashes, rows = word_hashes(batch.column(1), WORD_WITHOUT_UNDERSCORE)
        terms = _runs(hashes, TERM)
        whole = rows[: len(terms)] == rows[TERM - 1 :] if len(terms) else np.zeros(0, bool)
        rows, terms = rows[: len(terms)][whole], terms[whole]
        pos = np.arange(len(rows)) - np.searchsorted(rows, rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(pos.astype(np.int32)), pa.array(terms.view(np.int64))], ["item_id", "pos", "term"])


def bm25(items: DataFrame, hot: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(postings: item_id, term, weight) and (thresholds: item_id, threshold) of `items` (item_id, text), one row an item. Terms that
    more than `hot` items share are spread when they meet their frequency."""
    kind = items.schema["item_id"].dataType.simpleString()
    places = cut(items.mapInArrow(_term_rows, f"item_id {kind}, pos int, term long"))
    counts = cut(places.groupBy("item_id", "term").agg(F.count("*").alias("n")))
    df = cut(counts.groupBy("term").agg(F.count("*").alias("df")))
    lengths = counts.groupBy("item_id").agg(F.sum("n").alias("length"))
    totals = lengths.agg(F.count("*").alias("items"), F.avg("length").alias("mean")).first()
    total, mean = totals["items"] or 0, max(1.0, totals["mean"] or 1.0)
    idf = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("length") / mean)
    known = salted_join(counts, df, hot_keys(df, ["term"], "df", hot), ["term"], F.col("item_id")).join(lengths, "item_id")
    postings = cut(known.select("item_id", "term", (idf * F.col("n") * (K1 + 1) / (F.col("n") + norm)).alias("weight")))
    terms = LEAST_RUN - TERM + 1
    run = W.partitionBy("item_id").orderBy("pos").rowsBetween(0, terms - 1)
    windows = places.join(postings, ["item_id", "term"]).select("item_id", F.collect_set(F.struct("term", "weight")).over(run).alias("own"), F.count("*").over(run).alias("n"))
    least = F.aggregate("own", F.lit(0.0), lambda a, x: a + x["weight"])
    return postings, windows.where(F.col("n") == terms).groupBy("item_id").agg(F.min(least).alias("threshold"))


class ItemIndex:
    """One block of the inverted index: postings by term, with the greatest weight of each block of 16."""

    def __init__(self, items: list[tuple[int, str, float]], postings: list[tuple[int, int, float]]):
        items = sorted(items)
        self.ids = [i for i, _, _ in items]
        self.words = [words_of(t) for _, t, _ in items]
        self.parts = [questions_and_answers(t) for _, t, _ in items]
        self.thresholds = np.array([x for _, _, x in items]) - 1e-9
        place = {i: k for k, i in enumerate(self.ids)}
        rows = [(t, place[i], w) for i, t, w in postings if i in place]
        terms = np.array([t for t, _, _ in rows], np.int64).view(np.uint64)
        own, weights = np.array([k for _, k, _ in rows], np.int64), np.array([w for _, _, w in rows])
        order = np.lexsort((own, terms))
        own, weights = own[order], weights[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        ends = np.append(starts[1:], len(own))
        self.lists = [list(zip(own[a:b].tolist(), weights[a:b].tolist(), strict=True)) for a, b in zip(starts, ends, strict=True)]
        self.bounds = np.maximum.reduceat(weights, starts) if len(starts) else np.zeros(0)
        self.blocks = [[(x[min(s + BLOCK, len(x)) - 1][0], max(w for _, w in x[s : s + BLOCK])) for s in range(0, len(x), BLOCK)] for x in self.lists]
        self.least = float(self.thresholds.min()) if items else math.inf
        self.skipped = 0  # postings that block-max passed over
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.terms >> np.uint64(44)] = True

    def hits(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose term is in the index, and the terms' numbers."""
        at = np.flatnonzero(self.seen[runs >> np.uint64(44)])
        if not at.size:
            return at, at
        n = np.minimum(np.searchsorted(self.terms, runs[at]), len(self.terms) - 1)
        ok = self.terms[n] == runs[at]
        return at[ok], n[ok]

    def search(self, terms: list[int]) -> list[int]:
        """Block-max WAND: all items whose score against the terms reaches their threshold."""
        found, cursors = [], [[t, 0] for t in set(terms)]
        while cursors:
            cursors.sort(key=lambda c: self.lists[c[0]][c[1]][0])
            bound, pivot = 0.0, -1
            for k, (t, _) in enumerate(cursors):
                bound += self.bounds[t]
                if bound >= self.least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = self.lists[cursors[pivot][0]][cursors[pivot][1]][0]
            while pivot + 1 < len(cursors) and self.lists[cursors[pivot + 1][0]][cursors[pivot + 1][1]][0] == item:
                pivot += 1
            block, upto = 0.0, len(self.ids)
            for t, p in cursors[: pivot + 1]:
                b = p // BLOCK
                while b < len(self.blocks[t]) and self.blocks[t][b][0] < item:
                    b += 1
                if b < len(self.blocks[t]):
                    block, upto = block + self.blocks[t][b][1], min(upto, self.blocks[t][b][0] + 1)
            if pivot + 1 < len(cursors):
                upto = min(upto, self.lists[cursors[pivot + 1][0]][cursors[pivot + 1][1]][0])
            if block < self.least:
                target = max(upto, item + 1)  # no item before that can reach any threshold
                self.skipped += target - item - 1
            else:
                if block >= self.thresholds[item]:
                    score = 0.0
                    for t, p in cursors[: pivot + 1]:
                        x = self.lists[t]
                        while p < len(x) and x[p][0] < item:
                            p += 1
                        if p < len(x) and x[p][0] == item:
                            score += x[p][1]
                    if score >= self.thresholds[item]:
                        found.append(item)
                target = item + 1
            for c in cursors[: pivot + 1]:
                x = self.lists[c[0]]
                while c[1] < len(x) and x[c[1]][0] < target:
                    c[1] += 1
            cursors = [c for c in cursors if c[1] < len(self.lists[c[0]])]
        return found


def _verified(doc: list[str], item: list[str]) -> bool:
    """Whether 12 consecutive words of the item stand in the document."""
    runs = {tuple(item[k : k + LEAST_RUN]) for k in range(len(item) - LEAST_RUN + 1)}
    firsts = {r[0] for r in runs}
    return any(w in firsts and tuple(doc[k : k + LEAST_RUN]) in runs for k, w in enumerate(doc[: len(doc) - LEAST_RUN + 1]))


_SENTENCE = re.compile(r"[^.!?…\n]*[.!?…]*")


def questions_and_answers(text: str) -> tuple[set, set]:
    """The five-word runs of an item's questions (sentences that end with a question mark) and of all else."""
    asked, told = [], []
    for sentence in _SENTENCE.findall(text):
        words = words_of(sentence)
        (asked if sentence.rstrip().endswith("?") else told).append({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    return set().union(*asked), set().union(*told)


def leaks_in(index: ItemIndex, texts: pa.Array) -> Iterator[tuple[int, int, float | None, float | None]]:
    """(row, item number, share of the questions, share of the answers) of each verified leak of a column of texts; a share is null
    where the item has no such part."""
    hashes, rows = word_hashes(texts, WORD_WITHOUT_UNDERSCORE)
    at, terms = index.hits(_runs(hashes, TERM))
    same_text = rows[at] == rows[np.minimum(at + TERM - 1, len(rows) - 1)]
    at, terms = at[same_text], terms[same_text]
    if not at.size:
        return
    starts = np.searchsorted(rows, np.arange(len(texts) + 1))
    # each place lies in the passage that begins at its stride and in those before that still reach it
    row, place = rows[at], at - starts[rows[at]]
    passages = []
    for back in range(PASSAGE // STRIDE):
        n = place // STRIDE - back
        inside = (n >= 0) & (place + TERM <= n * STRIDE + PASSAGE)
        passages.append(np.stack([row[inside], n[inside], terms[inside]]))
    queries = np.concatenate(passages, axis=1)
    # the sum of the terms' greatest weights bounds every score of a passage; terms that come twice only raise it
    _, passage = np.unique(queries[0] * (int(place.max()) + 1) + queries[1], return_inverse=True)
    queries = queries[:, np.bincount(passage, index.bounds[queries[2]])[passage] >= index.least]
    if not queries.shape[1]:
        return
    queries = np.unique(queries, axis=1)
    first = np.flatnonzero(np.append(True, (queries[:2, 1:] != queries[:2, :-1]).any(axis=0)))
    bounds = np.add.reduceat(index.bounds[queries[2]], first)
    found: dict[int, set[int]] = {}
    ends = np.append(first[1:], queries.shape[1])
    answers: dict[tuple, list[int]] = {}
    for k in np.flatnonzero(bounds >= index.least).tolist():
        asked = tuple(queries[2, first[k] : ends[k]].tolist())
        if asked not in answers:
            answers[asked] = index.search(list(asked))
        if answers[asked]:
            found.setdefault(int(queries[0, first[k]]), set()).update(answers[asked])
    for n, own in found.items():
        doc = words_of(texts[n].as_py())
        runs = None
        for item in sorted(own):
            if _verified(doc, index.words[item]):
                runs = runs if runs is not None else {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
                yield n, item, *(len(part & runs) / len(part) if part else None for part in index.parts[item])


def leak_overlap(documents: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, question, answer): distinct leaked pairs, and the shares of the item's question and answer runs of five words
    that the document holds; null where the item has none."""
    spark = documents.sparkSession
    items = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    postings, thresholds = bm25(items)
    known = cut(items.join(thresholds, "item_id"))
    docs = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, question double, answer double"
    blocks = max(1, math.ceil((known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for k in range(blocks):
        rows = [tuple(r) for r in known.where(block == k).select("item_id", "text", "threshold").collect()]
        if not rows:
            continue
        index = spark.sparkContext.broadcast(ItemIndex(rows, [tuple(r) for r in postings.where(block == k).select("item_id", "term", "weight").collect()]))

        def scan(batches: Iterable[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if pairs := list(leaks_in(index.value, batch.column(1))):
                    row, item, question, answer = zip(*pairs, strict=True)
                    own = [index.value.ids[i] for i in item]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(own), pa.array(question, pa.float64()), pa.array(answer, pa.float64())], ["doc_id", "item_id", "question", "answer"])

        part = docs.mapInArrow(scan, schema).groupBy("doc_id", "item_id").agg(F.max("question").alias("question"), F.max("answer").alias("answer"))
        if blocks > 1:  # written, so that the block's index can go
            part = cut(part)
            index.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def leaked_items(documents: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id): distinct pairs."""
    return leak_overlap(documents, items, block_bytes).select("doc_id", "item_id")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, item_set, documents): how many documents each leaked item stands in."""
    found = leaked_items(documents, items)
    named = items.select("item_id", "item_set").dropDuplicates(["item_id"])
    return found.groupBy("item_id").agg(F.count("*").alias("documents")).join(named, "item_id").select("item_id", "item_set", "documents")
