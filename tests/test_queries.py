"""Queries against DuckDB on the smallest tables, and the shape of the entry module."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("node_count_by_type", "relation_degrees", "normalized_edge_weights", "spmm_forward", "cand_fallback", "relation_profiles", "coarse_labels_majority", "cluster_size_histogram", "confusion", "relation_budget_allocation", "pareto_frontier")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_runs_and_has_a_query(duck):
    queries = entry.queries()
    for name, sql in entry.oracle_sql().items():
        assert name in queries
        if not name.startswith("op"):
            duck.execute(sql)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=False, rtol=0, atol=1e-9)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
