import math
import random

import pytest

from codequarry.llm import leaks as K


def brute(docs, items):
    runs = {}
    for i, t in items:
        w = K.words_of(t) if t else []
        for k in range(len(w) - 11):
            runs.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        w = K.words_of(t) if t else []
        for k in range(len(w) - 11):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + 12]), ())}
    return out


@pytest.mark.parametrize("seed, block", [(1, 1 << 24), (2, 1500), (3, 900)])
def test_leaks_equal_brute_force(spark, seed, block):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(25)]  # few words, so that runs of five meet by chance
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(5, 60)))) for k in range(30)] + [(99, None), (98, "")]
    docs = []
    for d in range(120):
        w = [r.choice(words) for _ in range(r.randint(0, 200))]
        if r.random() < 0.6:
            source = K.words_of(items[r.randrange(30)][1])
            n = r.randint(8, 30)
            s = r.randrange(max(1, len(source) - n + 1))
            at = r.randrange(len(w) + 1)
            w[at:at] = source[s : s + n]
        docs.append((d, ", ".join(w).upper()))
    docs += [(500, None), (501, ""), docs[0]]
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, item_id int").repartition(4)
    it = spark.createDataFrame([(i, t, "set") for i, t in items], "item_id long, text string, item_set string")
    assert {(x["doc_id"], x["item_id"]) for x in K.leaked_items(df, it, block).collect()} == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string, item_set string")
    assert K.leaked_items(docs, items).count() == 0 and K.leaked_items(docs.where("false"), items).count() == 0


def index_of(spark, items):
    df = spark.createDataFrame(items, "item_id long, text string")
    postings, thresholds = K.bm25(df)
    return K.ItemIndex([tuple(r) for r in df.join(thresholds, "item_id").select("item_id", "text", "threshold").collect()], [tuple(r) for r in postings.collect()])


def test_weights_are_those_of_bm25(spark):
    items = [(k, " ".join(random.Random(k).choices("abcdefgh", k=20 + k))) for k in range(9)]
    index = index_of(spark, items)
    own = {i: [tuple(w[k : k + 2]) for k in range(len(w) - 1)] for i, t in items for w in [t.split()]}
    mean = sum(map(len, own.values())) / len(own)
    df = {}
    for pairs in own.values():
        for p in set(pairs):
            df[p] = df.get(p, 0) + 1

    def weight(i, p):
        n = own[i].count(p)
        return math.log(1 + (9 - df[p] + 0.5) / (df[p] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own[i]) / mean))

    want = sorted(round(weight(i, p), 9) for i in own for p in set(own[i]))
    assert sorted(round(w, 9) for x in index.lists for _, w in x) == want
    for k, (i, _) in enumerate(items):
        least = min(sum(weight(i, p) for p in set(own[i][s : s + 11])) for s in range(len(own[i]) - 10))
        assert abs(index.thresholds[k] - least) < 1e-6


def test_search_returns_all_items_at_or_above_their_threshold_and_skips_blocks(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(9)]
    # texts in order of how often their first words come, so that blocks differ in their greatest weights
    index = index_of(spark, [(k, " ".join(r.choices(words, [1 + k] * 3 + [300 - k] * 6, k=r.randint(20, 80)))) for k in range(300)])
    assert max(map(len, index.lists)) > 8 * K.BLOCK
    found = 0
    for _ in range(200):
        terms = r.sample(range(len(index.lists)), r.randint(3, 14))
        scores = {}
        for t in terms:
            for item, w in index.lists[t]:
                scores[item] = scores.get(item, 0) + w
        got = index.search(terms)
        assert sorted(got) == sorted(i for i, s in scores.items() if s >= index.thresholds[i])
        found += len(got)
    assert index.skipped > 0 and found > 0


def test_questions_and_answers_are_verified_apart(spark):
    asked, told = "Which one of the many small parts holds the key of the first old door?", "The blue part in the middle of the last row holds it until the second shift has ended."
    items = spark.createDataFrame([(1, f"{asked} {told}", "s"), (2, "no question here but a long enough row of words to be found again", "s")], "item_id long, text string, item_set string")
    docs = spark.createDataFrame([(1, f"x {asked.upper()} y"), (2, told), (3, f"{told} {asked}"), (4, "so: no question here but a long enough row of words to be found again"), (5, "nothing")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["question"], r["answer"]) for r in K.leak_overlap(docs, items).collect()}
    assert found == {(1, 1): (1.0, 0.0), (2, 1): (0.0, 1.0), (3, 1): (1.0, 1.0), (4, 2): (None, 1.0)}


def test_very_long_document(spark):
    item = " ".join(f"q{k}" for k in range(40))
    text = "x y z " * 60_000 + item + " x" * 50_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert K.leaked_items(docs, spark.createDataFrame([(7, item, "s")], "item_id long, text string, item_set string")).collect() == [(1, 7)]
