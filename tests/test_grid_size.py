"""The long grid sends no table of tracks or bars to all executors, and its summaries don't sort its rows."""

import pytest

from timegrid.operators import bars, grid, loops, stats


@pytest.fixture(scope="module")
def long(spark):
    rows = bars.bars(spark.createDataFrame([(k, float(t)) for k in (1, 2) for t in range(0, 20, 2)], "track_id long, t double"))
    onsets = spark.createDataFrame([(k, t / 7.0) for k in (1, 2) for t in range(130)], "track_id long, t double")
    return grid.grid_long(rows, onsets)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nothing_is_broadcast(long):
    assert "Broadcast" not in plan(long)
    assert "Broadcast" not in plan(grid.grid_wide(long, ["uncorrected", "standard_L2"]))


def test_rms_adds_up_by_bar(long):
    assert plan(stats.rms(long)).count("Window") == plan(long).count("Window")
    got = {(r.track_id, r.method): (r.n, r.rms_ms) for r in stats.rms(long).collect()}
    rows = [r.asDict() for r in long.collect()]
    for track, method in got:
        own = [r for r in rows if (r["track_id"], r["method"]) == (track, method)]
        total, n = 0.0, 0
        for r in own:
            if r["onset_time"] is not None:
                times = [x["grid_time"] for x in own if x["bar"] == r["bar"] and x["grid_time"] is not None]
                dur = (max(times) - min(times)) * 16 / 15 if len(times) > 1 else 2.0
                near = min(range(16), key=lambda i: (abs(r["phase"] - i / 16), i)) / 16
                total, n = total + ((r["phase"] - near) * dur * 1000) ** 2, n + 1
        assert got[track, method] == (n, pytest.approx((total / n) ** 0.5 if n else 0.0, abs=1e-6))


def test_loop_bounds_take_a_row_for_each_bar(long):
    text = plan(loops.loop_bounds(long, 4))
    assert text.index("Window") < text.index("min(CASE WHEN (tick")  # the plan's first lines come last
