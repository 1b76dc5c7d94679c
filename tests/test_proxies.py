"""Every proxy of the views stands in the queries and their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tracegraph.operators import views
from tracegraph.plans.registry import tables

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, view, width", [("structural_proxy_view", views.structural_proxy_view, 59), ("full_feature_matrix", views.full_feature_matrix, 42 + 15 + 59)])
def test_no_proxy_is_left_out(spark, name, view, width):
    t = tables(spark, DIR)
    columns = [c for c in view(t.itg).columns if c != "trace_id"]
    assert len(columns) == width
    assert sorted(entry.queries()[name](spark, DIR).columns) == sorted(["trace_id", *columns])
    con = duckdb.connect()
    for table in ("events", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    assert {f"rw_{i}" for i in range(12)} <= {d[0] for d in con.execute(entry.oracle_sql()[name]).description}
