"""Every query of the catalog that SQL can express equals its DuckDB twin."""

import duckdb
import pytest

from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "lineitem"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_batch_search_has_no_cross_join(spark):
    plan = catalog.QUERIES["knn_batch_sql"](spark, SF)._jdf.queryExecution().toString()
    assert "Join Cross" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_recall_of_approximate_search(spark):
    assert catalog.QUERIES["ann_recall"](spark, SF).first()["recall"] >= 0.95


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark).orderBy("rank").collect()
    assert len(got) == 10 and got[0]["id"] == 0 and got[0]["distance"] == 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
