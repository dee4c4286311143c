"""Every query of the core against its SQL, on the smallest test tables."""

import os

import duckdb
import pytest

from codequarry.plans import queries as Q


def norm(v):
    if v is None or v != v:
        return None
    return v if isinstance(v, (str, bool)) else round(float(v), 5)


def rows(frame):
    return sorted((tuple(norm(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in os.listdir(data):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{data}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    got, want = Q.queries()[name](spark, data).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_runs(spark, data, name):
    assert Q.queries()[name](spark, data).count() > 0


def test_index_recall(spark, data):
    assert Q.knn_index_recall(spark, data).first()["recall"] >= 0.9


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


# what each query has to read of its table, and nothing more
READS = {
    "repo_list": {"id", "repo", "indexed_at"}, "repo_count": {"id", "repo", "indexed_at"}, "repo_stats": {"id", "repo", "language", "symbol_type", "indexed_at"}, "lang_detect": {"file_id", "relative_path", "scanned_at"},
    "gitignore_filter": {"file_id", "relative_path", "scanned_at"}, "glob_include_exclude": {"file_id", "relative_path", "scanned_at"}, "late_scans": {"file_id", "repo", "scanned_at", "n_bytes"},
}


@pytest.mark.parametrize("name", READS)
def test_queries_read_only_what_they_need(spark, data, name):
    import re

    plan = Q.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    read = [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]
    assert read and all(r <= READS[name] for r in read)
