import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.llm import layout_copies as L

SCHEMA = "id string, text string, symbol_type string, language string, path string, h1 int, extra string"


def frame(spark, rows):
    """(id, text[, symbol_type, language, path]) with clashing and extra columns."""
    full = [(*r, *("function", "python", "a.py")[len(r) - 2 :], 1, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def found(df, **k):
    return {(r["first_id"], r["id"]) for r in L.layout_copies(df, **k).collect()}


def test_groups_and_edge_cases(spark):
    rows = [("b", "def f(x):\n  return x"), ("a", "DEF F ( X ) : return X ;"), ("c", "def g"), ("d", None), (None, "def f(x): return x"), ("e", ""), ("f", " ;; \n"), ("b", "def f(x):\n  return x"), ("g", "É-tude"), ("h", "étude")]
    assert found(frame(spark, rows)) == {("a", "b"), ("e", "f"), ("g", "h")}
    assert found(frame(spark, rows).where("false")) == set()


def test_fields_in_any_order_but_not_swapped(spark):
    y = ("block", "yaml", "x.yml")
    rows = [
        ("1", "my_head:\n  one_key: 12\n  two: \"a b\"", *y), ("2", "MyHead:\n   two:   'a b'\n\n   oneKey: 1.2", "block", None, "y.YAML"), ("3", '{"my-head": {\n "two": "a b", "one-key": 12\n}}', "block", "json", "z.json"),
        ("4", "my_head:\n  one_key: \"a b\"\n  two: 12", *y), ("5", "other:\n  one_key: 12\n  two: a b", *y), ("6", "x_y: 1\nz: 2", "function", "yaml", "q.yml"), ("7", "z: 2\nx_y: 1", "function", "yaml", "q.yml"),
        ("8", "# head\nA=1\nB=2", "block", "config", "p.env"), ("9", "# HEAD\nB = 2\nA = 1", "block", "config", "p.env"), ("10", "# head\nA=12\nB=", "block", "config", "p.env"),
    ]
    assert found(frame(spark, rows)) == {("1", "2"), ("1", "3"), ("8", "9")}


def test_hot_group_is_spread_and_complete(spark):
    rows = [(f"{k:05d}", "same text" + " " * (k % 7)) for k in range(600)] + [(f"z{k}", f"own {k}") for k in range(50)]
    assert found(frame(spark, rows).repartition(6), hot=50) == {("00000", f"{k:05d}") for k in range(1, 600)}
    counts = L.copy_counts(frame(spark, rows)).collect()
    assert [(r["first_id"], r["copies"]) for r in counts] == [("00000", 600)]


def test_collisions_are_split_exactly(spark, monkeypatch):
    """With a hash that tells nothing apart, the comparison and the exact digest still give the true groups."""
    rows = [("a", "one"), ("b", "O N E"), ("c", "two"), ("d", "TWO"), ("e", "three")]
    df = frame(spark, rows)
    real = L.hashed_batches
    # sent by value, so that the workers run this one
    def blind(batches):
        import pyarrow as pa

        for b in batches:
            zero = pa.array([0] * b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), zero, zero], ["id", "h1", "h2"])

    monkeypatch.setattr(L, "hashed_batches", blind)
    assert found(df) == {("a", "b"), ("c", "d")}
    assert L.hashed_batches is not real


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_hash_and_comparison_agree_with_canonical_text(a, b):
    def canon(t):
        return "".join(next((c for c in sign.lower() if c.isalnum()), "") for sign in t)

    h = L.rolling_hashes(pa.array([a, b], pa.string()))
    same = canon(a) == canon(b)
    assert bool((h[:, 0] == h[:, 1]).all()) == same
    assert L.same_but_layout(a, b) == same


def test_long_text_over_several_windows():
    r = random.Random(1)
    long = "".join(r.choice("ab1 _\n") for _ in range(700_000))
    h = L.rolling_hashes(pa.array(["x", long, long.upper().replace("\n", " \n "), long + "c"], pa.string()))
    assert (h[:, 1] == h[:, 2]).all() and (h[:, 1] != h[:, 3]).any()


@pytest.mark.parametrize("text, fields", [("a:\n  b: 1\n  c:\n    d: 2\n    e: 3", 2), ("[s]\nx = 1\ny=2", 2), ('{"a": {"b": [1, 2], "c": {"d": 1}}}', 2), ("a=1\nb=2", 2), ("", 0), ("{", 0)])
def test_block_fields(text, fields):
    assert len(L.block_fields(text)[1]) == fields


WIDE = ["Ünïcode É", "ünïcode, é", "İstanbul", "istanbul", "straße", "STRASSE", "日本 語", "日本語", "a–b", "ab", "x\U00020000y", "X \U00020000 Y", "\U0001f389 done", "DONE", "ﬁ", "fi", "٣", "3", "e\u0301", "e", "Ǆ", "ǆ", "ǅ", "", "…", "Σς", "σς"]


def test_wide_letters_are_folded_by_the_table():
    """Hashes agree exactly where the letters and digits, in lower case, do."""
    import pyarrow as pa

    folded = ["".join(c for c in t.lower() if c.isalnum()) for t in WIDE]
    for texts in (WIDE, WIDE[::-1], [t for t in WIDE if t.isascii()]):
        hashed = list(zip(*L.rolling_hashes(pa.array(texts, pa.large_string())).tolist(), strict=True))
        own = [folded[WIDE.index(t)] for t in texts]
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert (hashed[i] == hashed[j]) == (own[i] == own[j]), (texts[i], texts[j])
    one = L.rolling_hashes(pa.array(["done"], pa.large_string()))[:, 0]
    assert (L.rolling_hashes(pa.array(["DONE \U0001f389"], pa.large_string()))[:, 0] == one).all()


def test_blocks_are_compared_by_fields_and_digested_alike():
    a, b, c = "s:\n  a: 1\n  b: É x\n  a: 2\n", "S:\n  a: 2\n  b: é, X\n  A: 1\n", "s:\n  a: 1\n  b: É x\n  a: 1\n"
    assert L.same_block(a, b) and not L.same_block(a, c)
    assert L.exact_digest(a, True) == L.exact_digest(b, True) != L.exact_digest(c, True)
    assert L.exact_digest("Ab c", False) == L.exact_digest("a-BC", False) != L.exact_digest("ab", False)


def test_colliding_fields_are_told_apart(monkeypatch):
    monkeypatch.setattr(L, "_field_hashes", lambda fields: [(0, 0)] * len(fields))
    assert L.same_block("s:\n  a: 1\n  b: 2\n", "s:\n  b: 2\n  a: 1\n") and not L.same_block("s:\n  a: 1\n  b: 2\n", "s:\n  b: 2\n  a: 3\n")
