"""The queries against DuckDB on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_point
from plexa.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
QUICK = ["degree_all", "top_indegree", "reciprocity_node", "clustering_mutual", "correlate", "describe_degree", "histogram_degree", "contract_graph", "density_grid", "color_degree", "layout_step", "event_ring_200", "ema_value", "trade_edges", "betweenness"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert a.equals(b.astype(a.dtypes.to_dict())) or (a.round(5).astype(str) == b.round(5).astype(str)).all().all()


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry_point.__file__)))


def test_entry(spark):
    assert entry_point.entry(spark).count() == 15
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
