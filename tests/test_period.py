"""Frames of unequal number, against numpy one bar at a time."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from timegrid.functions import cols as C
from timegrid.operators import period, stats


def interpolated(row, n):
    size = len(row)
    if size < 2:
        return np.full(n, row[0] if size else 0.0)
    return np.interp(np.linspace(0, 1, n, endpoint=False), np.linspace(0, 1, size, endpoint=False), row)


def correlation(x, y):
    total, scale = 0.0, 0.0
    for p, q in zip(x, y):
        n, m = np.linalg.norm(p), np.linalg.norm(q)
        if n >= 1e-9 and m >= 1e-9:
            total = total + np.array([np.dot(p, np.roll(q, s)) for s in range(len(p))])
            scale += n * m
    return float(np.max(total) / scale) if scale else 0.0


@pytest.mark.parametrize("n", [1, 16, 64])
def test_equal_frames(spark, n):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(size)]) for i, size in enumerate([0, 1, 2, 3, 15, 16, 17, 63, 64, 65, 200])]
    for r in spark.createDataFrame(rows, "i long, f array<double>").select("i", C.equal_frames(F.col("f"), n).alias("v")).collect():
        assert np.allclose(r.v, interpolated(rows[r.i][1], n), atol=1e-12)


def test_stacked_correlations(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for m, t in [(1, 8), (4, 8), (4, 8), (3, 5), (4, 64)] * 5:
        pairs.append((rng.normal(size=(m, t)) * (rng.random((m, 1)) > 0.2), rng.normal(size=(m, t))))
    pairs += [(np.zeros((2, 4)), np.ones((2, 4))), (np.ones((2, 4)), np.ones((2, 5))), (np.ones((3, 4)), np.ones((2, 4)))]
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(pairs)] + [(len(pairs), None, [[1.0]])], "i int, a array<array<double>>, b array<array<double>>")
    got = {r.i: r.s for r in rows.select("i", period.channel_correlation("a", "b").alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        want = correlation(a, b[: len(a)]) if a.shape[1] == b.shape[1] else 0.0
        assert got[i] == pytest.approx(want, abs=1e-9), i
    assert got[len(pairs)] == 0.0


def test_period_of_ragged_bars(spark):
    """Bars repeat every four, each with another number of frames."""
    rng = np.random.default_rng(5)
    shapes = rng.normal(size=(4, 3, 64))
    rows = []
    for bar in range(8):
        size = int(rng.integers(30, 120))
        for c in range(3):
            at = np.arange(size) / size * 64
            rows.append((1, bar, c, np.interp(at, np.arange(64), np.repeat(shapes[bar % 4, c].reshape(8, 8).mean(axis=1), 8)).tolist()))
    frames = spark.createDataFrame(pd.DataFrame(rows, columns=["track_id", "bar", "channel", "frames"]))
    assert [(r.track_id, r.L) for r in period.multichannel_period(frames).collect()] == [(1, 4)]
    assert period.multichannel_period(frames.limit(0)).count() == 0


@pytest.mark.parametrize("q", [0.5, 0.1, 0.99])
def test_exact_percentile(spark, q):
    """Against numpy, with a coarse sketch: groups of one to thousands of rows, repeats, nulls."""
    rng = np.random.default_rng(4)
    groups = {k: rng.normal(size=n).round(r) for k, (n, r) in enumerate([(1, 9), (2, 9), (3, 9), (7, 0), (100, 1), (101, 9), (4000, 9), (4001, 1), (2000, 0)])}
    rows = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs] + [(3, None)], "k long, x double").repartition(5)
    got = {r.k: (r.n, r.x) for r in stats.exact_percentile(rows, ["k"], "x", q, accuracy=50).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert got[k] == (len(xs), pytest.approx(np.quantile(xs, q), abs=1e-12)), k
    assert stats.exact_percentile(rows, [], "x", q, 50).first().x == pytest.approx(np.quantile(np.concatenate(list(groups.values())), q), abs=1e-12)


def test_contours_are_shuffled_once(spark):
    """Values and bars meet once by track; pairs of bars, medians and the choice need no other exchange."""
    rng = random.Random(8)
    values = spark.createDataFrame([(k, rng.uniform(0, 40), rng.uniform(-1, 5)) for k in range(4) for _ in range(200)], "track_id long, t double, value double")
    bars = spark.createDataFrame([(k, i, float(i), i + 1.0) for k in range(4) for i in range(40) if i % 7], "track_id long, bar int, start double, end double")
    found = period.contour_period(values, bars)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    # bars that are left out don't bring others nearer
    pairs = period.lag_pairs(period.resampled(values, bars))
    assert {(r.track_id, r.bar, r.other, r.lag) for r in pairs.collect()} == {(k, i, i + n, n) for k in range(4) for i in range(40) for n in range(1, 10) if i % 7 and i + n < 40 and (i + n) % 7}
    for r in period.resampled(values, bars).join(bars, ["track_id", "bar"]).collect():
        own = sorted((x.t, x.value) for x in values.where(f"track_id = {r.track_id} AND value > 0 AND t >= {r.start} AND t < {r.end}").collect()) if r.track_id == 0 else []
        if own:
            t, y = map(np.array, zip(*own))
            assert np.allclose(r.v, np.interp(np.linspace(t[0], t[-1], 16), t, y), atol=1e-9)
