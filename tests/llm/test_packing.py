import random

import numpy as np
import pytest

from codequarry.llm import packing as P


def best_fit_by_item(sizes, capacity):
    """Best-fit decreasing, one item at a time: the gaps that are left, sorted."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= s
        else:
            gaps.append(capacity - s)
    return gaps


def rounds(counts, capacity, ranges=8):
    """The rounds of `best_fit` over lists: (matches, containers, rounds)."""
    items, gaps, plan, containers, n = [(s, 0, k) for s, k in counts.items()], [], [], 0, 0
    need = lambda own: max(-(-sum(s * k for s, _, k in own) // capacity), sum(k for s, _, k in own if 2 * s > capacity))
    key = lambda v: (v - 1) * ranges // capacity
    opening = need(items)
    while items:
        if opening:
            gaps.append((capacity, containers, opening))
            containers += opening
        n += 1
        left, open_gaps, found = [], [], []
        for k in {key(x[0]) for x in items + gaps}:
            i, g, m = P.swept([x for x in items if key(x[0]) == k], [x for x in gaps if key(x[0]) == k], lambda v, k=k: key(v) == k)
            left, open_gaps, found = left + i, open_gaps + g, found + m
        items, open_gaps, more = P.swept(left, open_gaps, lambda v: False)
        plan += found + more
        gaps = open_gaps + [m[:3] for m in found + more if m[0]]
        widest = max((g[0] for g in gaps), default=0)
        opening = need([x for x in items if x[0] > widest])
    return plan, containers, n


@pytest.mark.parametrize("seed", range(12))
def test_rounds_need_no_more_containers_than_item_by_item(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 37, 100])
    sizes = [min(capacity, max(1, int(r.expovariate(3 / capacity)))) for _ in range(r.randint(1, 400))]
    counts = {s: sizes.count(s) for s in set(sizes)}
    plan, containers, _ = rounds(counts, capacity)
    filled = [0] * containers
    ranks = {s: [] for s in counts}
    for _, first, n, size, rank, copies in plan:
        ranks[size] += range(rank, rank + n * copies)
        for i in range(n * copies):
            filled[first + i % n] += size
    assert all(sorted(v) == list(range(counts[s])) for s, v in ranks.items())
    assert max(filled) <= capacity and sum(filled) == sum(sizes)
    assert containers <= len(best_fit_by_item(sizes, capacity)) * 1.02 + 1


def test_ten_million_documents_and_a_large_capacity():
    """What a round works on grows with the capacity, not with the documents."""
    r = np.random.default_rng(3)
    capacity = 131_072
    values, n = np.unique(np.minimum(capacity, r.lognormal(7, 1.6, 10_000_000).astype(int) + 1), return_counts=True)
    plan, containers, n_rounds = rounds(dict(zip(values.tolist(), n.tolist(), strict=True)), capacity)
    tokens = int((values * n).sum())
    assert sum(m[2] * m[5] for m in plan) == 10_000_000
    assert containers * capacity * 0.998 <= tokens and n_rounds < 60 and len(plan) < 400_000


def test_documents(spark):
    r = random.Random(2)
    rows = [(k, " ".join("word" for _ in range(r.choice([3, 3, 3, 20, 70, 260]))), "x") for k in range(400)] + [(900, None, ""), (901, "", ""), (None, "a b", ""), (5, "short", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string").repartition(6)
    out = P.packed(df, capacity=100).collect()
    sizes = {x["doc_id"]: x["n"] for x in P.token_sizes(df).collect()}
    fill, by_doc = {}, {}
    for x in out:
        fill[x["container"]] = fill.get(x["container"], 0) + x["tokens"]
        by_doc.setdefault(x["doc_id"], []).append((x["piece"], x["first_token"], x["tokens"]))
    assert max(fill.values()) <= 100 and set(by_doc) == {*range(400), 900, 901}
    for d, pieces in by_doc.items():
        assert sum(t for _, _, t in pieces) == sizes[d] and [p for p, _, _ in sorted(pieces)] == list(range(len(pieces)))
        assert len(pieces) == 1 or sizes[d] > 100
        assert all(first == p * 100 for p, first, _ in pieces)
    assert len(fill) <= len(best_fit_by_item([x["tokens"] for x in out if x["tokens"]], 100)) + 2
    assert P.container_fill(df, capacity=100).where("room < 0").count() == 0


def test_empty_table(spark):
    assert P.packed(spark.createDataFrame([], "doc_id long, text string"), 50).count() == 0


def test_rounds_on_spark_place_every_rank_once(spark):
    r = random.Random(8)
    sizes = [r.choice([7, 7, 7, 31, 55, r.randint(1, 100)]) for _ in range(3000)]
    counts = {s: sizes.count(s) for s in set(sizes)}
    plan = P.best_fit(spark.createDataFrame(list(counts.items()), "value int, n long"), 100).collect()
    ranks, fill = {s: [] for s in counts}, {}
    for row in plan:
        for i in range(row["total"]):
            ranks[row["size"]].append(row["rank"] + i)
            c = row["first"] + i % row["n"]
            fill[c] = fill.get(c, 0) + row["size"]
    assert all(sorted(v) == list(range(counts[s])) for s, v in ranks.items()) and max(fill.values()) <= 100
    assert len(fill) <= len(best_fit_by_item(sizes, 100)) + 2


def test_a_size_of_very_many_documents_is_placed_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "RANK_BLOCK", 16)
    df = spark.createDataFrame([(k, "word " * (3 if k % 3 else 9)) for k in range(500)], "doc_id long, text string").repartition(5)
    out = P.packed(df, capacity=20).collect()
    fill = {}
    for x in out:
        fill[x["container"]] = fill.get(x["container"], 0) + x["tokens"]
    assert len(out) == 500 == len({x["doc_id"] for x in out}) and max(fill.values()) <= 20
