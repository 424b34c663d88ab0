"""Every design-space query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from designlens import analysis_queries, design_queries, edge_queries, feature_queries, graph_queries, match_queries, run_queries, space_queries, table_queries  # noqa: F401
from designlens import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rel = tables.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == expected
