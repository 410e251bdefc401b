"""Results that hang on last digits: equal sums of another order, and values on a rounding edge."""

import duckdb

from timegrid.operators import stats
from timegrid.plans import catalogue, formats  # noqa: F401


def test_best_is_the_first_of_equals(spark):
    """Two sums of the same terms, on both sides of an edge of nine decimals."""
    rows = [(1, "a", 2000.1234567895004), (1, "b", 2000.1234567894995), (2, "a", 2.0), (2, "b", 1.0)]
    assert round(rows[0][2], 9) != round(rows[1][2], 9)
    got = stats.rms_summary(spark.createDataFrame(rows, "track_id long, method string, rms_ms double"), ["a", "b"], "a")
    assert {r.track_id: r.best for r in got.collect()} == {1: "a", 2: "b"}


def test_wide_files_round_as_sql(spark, tmp_path):
    """Bars that start on edges of four decimals."""
    times = [540000, 5220000, 16740000, 20340000, 29340000, 40000001]
    con = duckdb.connect()
    values = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL {us} MICROSECOND, 1, 'click', 1.0)" for i, us in enumerate(times))
    con.execute(f"CREATE TABLE events AS SELECT CAST(id AS BIGINT) AS event_id, ts, CAST(u AS BIGINT) AS user_id, kind AS event_type, CAST(v AS DOUBLE) AS value FROM (VALUES {values}) x(id, ts, u, kind, v)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    names = ["track_id", "bar", "tick", "method", "L", "phase", "grid_time"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({catalogue.oracle_sql()['wide_files']})").fetchall()
    got = catalogue.queries()["wide_files"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_wide_files_of_few_bars_equal_sql(spark, tmp_path):
    """Tracks of one bar, which have no loops of two, beside one without bars and one of three."""
    rows = [(1, 600), (1, 4200), (2, 60), (3, 0), (3, 3600), (3, 9000), (3, 9900), (4, 7), (4, 11)]
    con = duckdb.connect()
    values = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL {s} SECOND, {u}, 'click', 1.0)" for i, (u, s) in enumerate(rows))
    con.execute(f"CREATE TABLE events AS SELECT CAST(id AS BIGINT) AS event_id, ts, CAST(u AS BIGINT) AS user_id, kind AS event_type, CAST(v AS DOUBLE) AS value FROM (VALUES {values}) x(id, ts, u, kind, v)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    names = ["track_id", "bar", "tick", "method", "L", "phase", "grid_time"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({catalogue.oracle_sql()['wide_files']})").fetchall()
    got = catalogue.queries()["wide_files"](spark, str(tmp_path)).select(*names).collect()
    assert {(r.track_id, r.method) for r in got if r.track_id != "3"} == {(k, m) for k in "14" for m in ("uncorrected", "per_snippet")}
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
