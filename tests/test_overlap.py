"""Overlaps of many windows, and folders of intermediate tables."""

import os
import random

from timegrid.operators import loops
from timegrid.sources import scratch


def test_many_windows_on_one_track(spark):
    rng = random.Random(2)
    cuts = sorted(rng.uniform(0, 500) for _ in range(400)) + [500.0]
    bars = [(1, i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(1, 900, 30.0, 30.0), (2, 0, 0.0, 9.0), (1, 901, 10.0, 20.0)]
    windows = [(1, k, w, w + rng.choice([0.0, 0.5, 7.0, 10.0, 80.0])) for k, w in enumerate(rng.uniform(-20, 520) for _ in range(1000))] + [(1, 1000, 20.0, 30.0), (3, 1, 0.0, 1.0)]
    rows = spark.createDataFrame(bars, "track_id long, bar int, start double, end double")
    spans = spark.createDataFrame(windows, "track_id long, w int, w_start double, w_end double")
    want = sorted((t, b, w) for t, b, s, e in bars for u, w, ws, we in windows if t == u and s < we and e > ws and ws <= we)
    for width in (3.0, 10.0):
        assert sorted(map(tuple, loops.overlapping(rows, spans, width).select("track_id", "bar", "w").collect())) == want


def test_folders_are_removed(spark):
    with scratch.cleared(spark):
        table = scratch.written(spark.range(3), "three")
        path = table.inputFiles()[0].removeprefix("file:").replace("///", "/")
        assert table.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
