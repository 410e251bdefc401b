"""The prioritised lookup over whole keys against its SQL."""

import os

import pytest

import __spark_entry__ as entry
from tests.test_queries import SF, rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_lookup_priority_all(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    df = entry.queries()["lookup_priority_all"](spark, SF)
    want = con.execute(entry.oracle_sql()["lookup_priority_all"])
    got = df.collect()
    assert rows(df.columns, map(tuple, got)) == rows([c[0] for c in want.description], want.fetchall())
    # one name in the last form for each order, and customers from 40 on with their own offsets
    assert len(got) > spark.read.parquet(f"{SF}/orders.parquet").count()
    assert all(r.offset == int(r.name.removesuffix("_take")) / 10 for r in got if r.name.removesuffix("_take").isdigit())
    assert all(r.offset == 0.0 for r in got if r.name.startswith("-"))
