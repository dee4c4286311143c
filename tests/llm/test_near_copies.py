import itertools
import random
import re

import pytest

from codequarry.llm import near_copies as N
from codequarry.llm.layout_copies import same_but_layout

SCHEMA = "id string, text string, symbol_type string, language string, path string, s int, bands int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "function", "python", "a.py", 1, 2) for i, t in rows], SCHEMA)


def brute(rows, threshold=0.7):
    sets = {}
    for i, t in rows:
        if i is None or t is None:
            continue
        w = re.findall(r"\w+", t.lower())
        if len(w) >= 30:
            sets[i] = ({tuple(w[k : k + 3]) for k in range(len(w) - 2)}, t)
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a][0], sets[b][0]
        if len(x & y) >= threshold * len(x | y) and not same_but_layout(sets[a][1], sets[b][1]):
            out.add((a, b))
    return out


def corpus(seed, families=12, size=5):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for f in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 160))]
        for v in range(size):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 14))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((f"{f:02d}-{v}", " ".join(own)))
    return rows


@pytest.mark.parametrize("seed, hot", [(1, 300), (2, 300), (3, 2)])
def test_pairs_equal_brute_force(spark, seed, hot):
    rows = corpus(seed) + [("null", None), (None, "x " * 50), ("short", "a b c"), ("00-0x", corpus(seed)[0][1].upper() + " !")]
    df = frame(spark, rows + rows[:5]).repartition(5)
    assert {(r["id_a"], r["id_b"]) for r in N.near_pairs(df, hot=hot).collect()} == brute(rows)


def test_hot_bucket_of_a_third_goes_through_rare_runs(spark):
    """120 texts share a long head, so all their band keys may meet; only true pairs come out."""
    r = random.Random(5)
    head = [f"h{k}" for k in range(20)]
    rows = [(f"{k:03d}", " ".join(head + [f"t{r.randrange(5000)}" for _ in range(40)])) for k in range(120)]
    rows += [(f"x{k}", rows[k][1] + " tail words") for k in range(10)]
    assert {(x["id_a"], x["id_b"]) for x in N.near_pairs(frame(spark, rows), hot=4).collect()} == brute(rows)


def test_empty_table(spark):
    assert N.near_pairs(frame(spark, [("a", "b")]).where("false")).count() == 0
    assert N.near_groups(frame(spark, [("a", "b")])).count() == 0


def test_groups_follow_chains(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(f"c{k}", " ".join(words[: 100 - 0] if k == 0 else [f"n{j}" if j < 5 * k else words[j] for j in range(100)])) for k in range(5)]
    found = {x["id"]: (x["group_id"], x["links"]) for x in N.near_groups(frame(spark, rows)).collect()}
    links = brute(rows)
    assert set(found) == {i for pair in links for i in pair} and {g for g, _ in found.values()} == {"c0"}
    assert all(n == sum(i in p for p in links) for i, (_, n) in found.items())


def test_sketch_estimates_high_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    for j in (0.7, 0.8, 0.9, 0.95):
        n = 200
        common = int(2 * n * j / (1 + j))
        sets = []
        for _ in range(40):
            x = rng.integers(1, 2**63, size=2 * n - common, dtype=np.uint64)
            sets += [np.unique(x[:n]), np.unique(np.concatenate([x[:common], x[n:]]))]
        offsets = np.cumsum([0] + [len(s) for s in sets])
        sketches = N.odd_sketches(N.min_samples(np.concatenate(sets), offsets)).view(np.uint64)
        odd = np.bitwise_count(sketches[0::2] ^ sketches[1::2]).sum(axis=1)
        assert abs(N.sketch_similarity(odd).mean() - j) < 0.04


def test_groups_hold_texts_that_differ_only_in_how_often_a_line_is_repeated(spark):
    line = " ".join(f"w{k}" for k in range(12)) + "\n"
    other = " ".join(f"v{k}" for k in range(40))
    rows = [("a", line * 4), ("b", line * 7), ("c", line * 4), ("d", other), ("e", other), ("f", " ".join(f"x{k}" for k in range(60))), ("g", " ".join(f"x{k}" for k in range(59)))]
    df = frame(spark, rows)
    pairs = {tuple(r) for r in N.near_pairs(df).collect()}
    assert pairs == {("a", "b"), ("b", "c"), ("f", "g")}
    assert {tuple(r) for r in N.near_groups(df).collect()} == {("a", "a", 0), ("b", "a", 0), ("c", "a", 0), ("f", "f", 1), ("g", "f", 1)}


def test_class_pairs_and_classes_hold_all_links(spark):
    rows = corpus(7, families=6) + [(f"copy{k}", corpus(7, families=6)[3][1].upper() + "!" * k) for k in range(15)]
    df = frame(spark, rows)
    classes = {r["id"]: r["class_id"] for r in N.near_classes(df).collect()}
    pairs = {(r["class_a"], r["class_b"]) for r in N.near_class_pairs(df).collect()}
    assert all(classes[a] == a and classes[b] == b for a, b in pairs)
    expanded = {tuple(sorted((x, y))) for a, b in pairs for x in classes if classes[x] == a for y in classes if classes[y] == b}
    assert expanded == brute(rows) and len(pairs) < len(expanded)


def test_large_nodes_are_expanded_over_slots(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(f"a{k:03d}", base + "." * k) for k in range(60)] + [(f"b{k:03d}", base + " tail" + "!" * k) for k in range(50)]
    found = {(r["id_a"], r["id_b"]) for r in N.near_pairs(frame(spark, rows), slot_rows=7).collect()}
    assert found == {(a, b) for a, _ in rows[:60] for b, _ in rows[60:]}


def test_a_run_of_very_many_nodes_meets_block_by_block(spark):
    """90 near-equal texts share nearly all their runs, rare ones included; blocks of 4 nodes still give every pair once."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = [(f"{k:02d}", " ".join(base[:40] + [f"n{r.randrange(9999)}"] + base[40:])) for k in range(90)]
    assert {(x["id_a"], x["id_b"]) for x in N.near_pairs(frame(spark, rows), hot=4).collect()} == brute(rows)
    keys = spark.createDataFrame([(k, [7, 100 + k], [0] * 8) for k in range(30)], "s long, runs array<int>, sketch array<long>")
    got = [tuple(x) for x in N._rare_run_pairs(keys, 0.3, 4).collect()]
    assert sorted(got) == [(a, b) for a in range(30) for b in range(a + 1, 30)]
