"""Every core query on empty tables of the right schema."""

import os

import pytest

from codequarry.plans import queries as Q


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for f in os.listdir(data):
        df = spark.read.parquet(f"{data}/{f}")
        (df.limit(0) if f.split(".")[0] in ("code_chunks", "source_files", "documents", "parsed_symbols") else df).write.parquet(f"{out}/{f}")
    return out


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs_on_empty_tables(spark, empty, name):
    Q.queries()[name](spark, empty).collect()
