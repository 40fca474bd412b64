"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os
import tempfile

import duckdb
import pandas as pd
import pytest
from granary.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}")
    return str(x)


def rows(df):
    return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


def test_snowflake_times_of_all_events(spark):
    ids = [0, 29_999, 30_000, 60_000, 5_000_000_000]
    folder = tempfile.mkdtemp(prefix="granary-")
    spark.createDataFrame([(k,) for k in ids], "event_id long").write.parquet(f"{folder}/events.parquet")
    out = {r.event_id: r.at for r in catalog.queries()["snowflake_time_all"](spark, folder).collect()}
    assert sorted(out) == ids
    assert out[30_000] == out[60_000] == out[0]


def test_components_of_all_orders(spark, tables):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in tables.execute("SELECT DISTINCT o_custkey, l_suppkey + 1000000 FROM orders JOIN lineitem ON l_orderkey = o_orderkey").fetchall():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in catalog.queries()["components_all"](spark, SF).collect()} == {x: find(x) for x in root}


def test_pairs_and_neighbours_cover_all_groups(spark, tables):
    label = dict(tables.execute("SELECT vec_id, label FROM embeddings").fetchall())
    assert {label[r.query_id] for r in catalog.queries()["knn_join_twentieth"](spark, SF).collect()} == {v for k, v in label.items() if k % 20 == 0}
    assert {label[r.a] for r in catalog.queries()["cosine_pairs_in_groups"](spark, SF).collect()} - {1, 2}


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_its_sql(spark, tables, name):
    out = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        expected = tables.execute(sql).df()
        assert sorted(out.columns) == sorted(expected.columns)
        assert rows(out) == rows(expected)
