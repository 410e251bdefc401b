"""Joins and windows of tracks that are cut, against those of whole tracks."""

import random

import pytest
from pyspark.sql import functions as F

from timegrid.operators import asof, bars, ranges, series


def stream(seed, n, hot=0.9):
    """Points with one track that holds most of them, in bursts, some at equal times."""
    rng = random.Random(seed)
    times = sorted(round(rng.choice([rng.random() * 1000, 400 + rng.random()]), 3) for _ in range(n))
    return [(1 if rng.random() < hot else rng.randrange(2, 9), t) for t in times]


@pytest.fixture(scope="module")
def sides(spark):
    points = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(stream(1, 1500))], "track_id long, t double, id int").repartition(3)
    bounds = spark.createDataFrame([x for x in stream(2, 300) if not 300 < x[1] < 390], "track_id long, t double").repartition(2)
    return points, bounds, ranges.cuts([(points, "t"), (bounds, "t")], rows=100)


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_ranges_have_about_equal_rows(sides):
    points, bounds, cuts = sides
    sizes = cuts.placed(points.select("track_id", "t").unionByName(bounds), "t").groupBy("track_id", "_range").count().collect()
    hot = [r["count"] for r in sizes if r["_range"] >= 0]
    assert {r["track_id"] for r in sizes if r["_range"] >= 0} == {r["track_id"] for r in points.unionByName(bounds, True).groupBy("track_id").count().where("count > 100").collect()}
    assert len(hot) >= 14 and max(hot) <= 200 and sum(r["count"] for r in sizes) == points.count() + bounds.count()


def test_as_of_joins_equal_those_of_whole_tracks(sides):
    points, bounds, cuts = sides
    assert rows(asof.last_before(points, bounds, cuts=cuts)) == rows(asof.last_before(points, bounds))
    targets = points.withColumnRenamed("t", "g")
    assert rows(asof.nearest(targets, bounds, cuts=cuts)) == rows(asof.nearest(targets, bounds))
    assert rows(asof.nearest_within(targets, bounds, F.lit(0.5), cuts=cuts)) == rows(asof.nearest_within(targets, bounds, F.lit(0.5)))


def test_bars_and_beats_equal_those_of_whole_tracks(sides):
    points, bounds, cuts = sides
    own = bars.bars(bounds)
    assert rows(bars.bars(bounds, cuts)) == rows(own)
    assert rows(asof.in_bars(points, own, cuts=cuts)) == rows(asof.in_bars(points, own))
    beats = points.select("track_id", "t").distinct()
    assert rows(asof.beats_to_bars(beats, bounds, cuts=cuts)) == rows(asof.beats_to_bars(beats, bounds))


@pytest.mark.parametrize("least", [0.3, 5000.0])
def test_spacing_equals_the_scan(sides, least):
    points, _, cuts = sides
    assert rows(series.min_spacing_in_ranges(points.where("id % 3 = 0"), least, cuts)) == rows(series.min_spacing(points.where("id % 3 = 0"), least))


def test_spacing_of_equal_steps(spark):
    # gaps of exactly `least` in binary and not
    points = spark.createDataFrame([(1, k * 0.1) for k in range(90)], "track_id long, t double")
    cuts = ranges.cuts([(points, "t")], rows=30)
    for least in (0.3,):
        assert rows(series.min_spacing_in_ranges(points, least, cuts)) == rows(series.min_spacing(points, least))


def test_tables_of_jumps_shrink(spark):
    """Chains of a hundred points and more: the tables of all widths together are no more than a few times the points."""
    rng = random.Random(6)
    points = spark.createDataFrame([(k, rng.uniform(-40, 60)) for k in (1, 2) for _ in range(1000)] + [(3, 1e6), (3, -1e6), (4, 0.0)], "track_id long, t double")
    sizes = []

    def keep(df, name):
        df = df.localCheckpoint()
        sizes.append((name, df.count()))
        return df

    got = series.min_spacing_in_ranges(points, 0.5, ranges.cuts([(points, "t")], rows=200), keep)
    assert rows(got) == rows(series.min_spacing(points, 0.5))
    assert sum(n for name, n in sizes if name == "jumps") < 3 * 2003


def test_no_long_track_and_empty_tables(spark, sides):
    points, bounds, _ = sides
    none = ranges.cuts([(points, "t"), (bounds, "t")], rows=10_000)
    assert none.levels == [] and rows(asof.last_before(points, bounds, cuts=none)) == rows(asof.last_before(points, bounds))
    empty = ranges.cuts([(points.limit(0), "t")])
    assert asof.nearest(points.limit(0).withColumnRenamed("t", "g"), bounds.limit(0), cuts=empty).count() == 0
    assert series.min_spacing_in_ranges(points.limit(0), 1.0, empty).count() == 0


def test_larger_tables_of_cuts_are_joined_by_key(sides, monkeypatch):
    points, bounds, _ = sides
    monkeypatch.setattr(ranges, "BROADCAST_ROWS", -1)
    cuts = ranges.cuts([(points, "t"), (bounds, "t")], rows=100)
    assert rows(asof.last_before(points, bounds, cuts=cuts)) == rows(asof.last_before(points, bounds))


def test_no_window_looks_to_its_end(sides):
    """Spark works such a frame out anew for each row, so a task's work grows with the square of its rows."""
    points, bounds, cuts = sides
    targets = points.withColumnRenamed("t", "g")
    placed = cuts.placed(points, "t").withColumn("even", F.when(F.col("id") % 2 == 0, F.col("id")))
    first = cuts.first(placed, "even", ["t", "id"], "next")
    for df in (asof.nearest(targets, bounds), asof.nearest(targets, bounds, cuts=cuts), first):
        plan = df._jdf.queryExecution().executedPlan().toString().lower()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    after = {}
    want = {}
    for r in sorted(points.collect(), key=lambda r: (r.track_id, r.t, r.id), reverse=True):
        after[r.track_id] = r.id if r.id % 2 == 0 else after.get(r.track_id)
        want[r.id] = after[r.track_id]
    assert {r.id: r.next for r in first.collect() if r._range >= 0} == {r.id: want[r.id] for r in placed.where("_range >= 0").collect()}
