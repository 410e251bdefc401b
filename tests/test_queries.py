"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ["bars_from_boundaries", "correct_bars", "beats_to_bars", "reference_offset", "rms_phase", "period_bic", "lag_profile", "min_spacing", "lookup_priority", "beat_fmeasure", "chunks", "loop_reference", "corrected_text", "length_files", "versioned_table", "stream_arrivals", "rms_patterns"]


def rows(columns, data):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows([c[0] for c in want.description], want.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
