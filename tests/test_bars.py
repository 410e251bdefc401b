"""Literal cases and closed forms of bars, repair, grid and periods."""

import random

import pytest
from pyspark.sql import functions as F

from timegrid.functions import cols as C
from timegrid.operators import asof, bars, grid, loops, period, prep, reports, series, stats


def points(spark, times, track="a"):
    return spark.createDataFrame([(track, float(t)) for t in times], "track_id string, t double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_nearest_prefers_the_earlier_of_two(spark):
    targets = spark.createDataFrame([("a", 3.4), ("a", 1.5), ("b", 1.0)], "track_id string, g double")
    rows = {(r.track_id, r.g): (r.nearest, r.distance) for r in asof.nearest(targets, points(spark, [1, 2, 3.5, 5])).collect()}
    assert rows["a", 3.4][0] == 3.5 and rows["a", 3.4][1] == pytest.approx(0.1)
    assert rows["a", 1.5][0] == 1.0
    assert rows["b", 1.0] == (None, None)


def test_reference_and_ticks(spark):
    onsets = points(spark, [0.05, 0.5, 1, 1.5, 2.05, 2.5, 3, 3.5, 4.05])
    rows = bars.bars(points(spark, [0, 2, 4, 6, 8]))
    ranges = grid.snippet_bars(rows, 0.0, 5.0)
    ref = grid.snippet_references(rows, ranges, onsets).first()
    assert (ref.ref_bar, ref.grid_phase) == (0, 0.0)
    assert ref.ref_ms == pytest.approx(50) and ref.ref_phase == pytest.approx(0.025)
    ticks = grid.onset_ticks(onsets, rows)
    assert column(ticks, "tick", "bar", "tick") == [0, 4, 8, 12, 0, 4, 8, 12, 0]
    found = grid.loop_references(grid.loops(rows, spark.createDataFrame([("a", 0, 3)], "track_id string, first_bar int, last_bar int"), 2), onsets)
    assert [(r.loop_bar, round(r.ref_ms, 6)) for r in found.orderBy("loop_bar").collect()] == [(0, 50.0), (2, 50.0)]


def test_tempo_classes_and_masks(spark):
    df = spark.createDataFrame([(120.0, 60.0), (30.0, 60.0), (60.0, 60.0)], "bpm double, base double")
    assert [r[0] for r in df.select(C.tempo_class(F.col("bpm"), F.col("base"))).collect()] == ["double", "half", "normal"]
    mask = spark.createDataFrame([(90.0,), (100.0,), (110.0,), (110.1,)], "x double")
    assert [r[0] for r in mask.select(C.within_percent(F.col("x"), F.lit(100.0))).collect()] == [True, True, True, False]


def walk(starts, end, actions):
    """The sequential form of the repair."""
    out, i = [], 0
    edges = [*starts, end]
    while i < len(starts):
        if actions[i] == "merge" and i + 1 < len(starts):
            out.append((edges[i], "merged"))
            i += 2
            continue
        if actions[i] == "merge":
            out.append((edges[i], "merge_impossible_tail"))
        elif actions[i] == "split":
            out += [(edges[i], "split_A"), ((edges[i] + edges[i + 1]) / 2, "split_B")]
        else:
            out.append((edges[i], "unchanged"))
        i += 1
    return out


def test_repair_equals_the_sequential_walk(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    kinds = {"merge": "double", "split": "half", "unchanged": "normal"}
    for track in range(60):
        n = rng.randint(1, 14)
        actions = [rng.choice(["merge", "merge", "split", "unchanged"]) for _ in range(n)]
        starts = [float(2 * i) for i in range(n)]
        rows += [(track, i, starts[i], starts[i] + 2, kinds[a], 100.0, None, "normal", "") for i, a in enumerate(actions)]
        expected[track] = walk(starts, starts[-1] + 2, actions)
    df = spark.createDataFrame(rows, "track_id int, bar int, start double, end double, class string, base double, override double, dominant string, orientation string")
    got = {}
    for r in bars.repaired(df).orderBy("track_id", "corrected_bar_num").collect():
        got.setdefault(r.track_id, []).append((r.start, r.action))
    assert got == expected


def test_time_signature_breaks_ties_by_first_bar(spark):
    rows = [("a", b, p) for b, n in ((0, 7), (1, 3), (2, 4), (3, 4), (4, 3)) for p in range(1, n + 1)] + [("b", 0, 0)]
    df = spark.createDataFrame(rows, "track_id string, bar_num int, beat_pos int")
    assert {r.track_id: r.time_signature for r in bars.time_signature(df).collect()} == {"a": 3, "b": 4}


def test_nearest_fraction_is_the_lower_argmin(spark):
    ps = [i / 640 - 0.2 for i in range(1000)]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(C.nearest_fraction(F.col("p"))).collect()]
    assert got == [min((k / 16 for k in range(16)), key=lambda g, p=p: (abs(p - g), g)) for p in ps]


def test_min_spacing_depends_on_what_is_kept(spark):
    assert column(series.min_spacing(points(spark, [1.0, 1.05, 2.0, 2.1, 2.16, 3.0]), 0.15), "t", "t") == [1.0, 2.0, 2.16, 3.0]


def test_min_spacing_gathers_no_track(spark):
    rng = random.Random(1)
    rows = [(k, rng.random() * 100) for k in (1, 2, None) for _ in range(4000)] + [(1, None)]
    got = series.min_spacing(spark.createDataFrame(rows, "track_id long, t double"), 0.5)
    want = []
    for k in (1, 2, None):
        last = None
        for t in sorted(t for x, t in rows if x == k and t is not None):
            if last is None or t - last >= 0.5:
                want.append((k, t))
                last = t
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_frame_labels(spark):
    rows = {r.frame: r.label for r in prep.frame_labels(points(spark, [4.0]), 1.0).collect()}
    assert rows == {2: 0.25, 3: 0.5, 4: 1.0, 5: 0.5, 6: 0.25}


def test_information_criteria(spark):
    lengths = [2400, 2450, 2380, 2420, 2400, 2440, 2390, 2410]
    times = [0.0]
    for x in lengths:
        times.append(times[-1] + x / 1000)
    rows = bars.bars(points(spark, times))
    b = {r.L: r.score for r in period.bic(rows).collect()}
    assert [b[k] for k in (1, 2, 4)] == pytest.approx([53.156138, 41.130104, 35.149197], abs=1e-4)
    a = {r.L: r.score for r in period.aicc(rows).collect()}
    assert [a[k] for k in (1, 2, 4)] == pytest.approx([55.956138, 46.184194, 57.311466], abs=1e-4)
    assert period.bic_period(period.bic(rows)).first().L == 4 and period.aicc_period(period.aicc(rows)).first().L == 2
    even = bars.bars(points(spark, [0, 2, 4, 6, 8, 10, 12, 14]))
    assert period.bic_period(period.bic(even)).first().L == 1 and period.aicc_period(period.aicc(even)).first().L == 4


def test_power_of_two(spark):
    profile = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate([0.9, 0.5, 0.3, 0.8, 0.2, 0.1, 0.05, 0.7])], "track_id string, lag int, value double")
    assert period.power_of_two(profile).first().L == 4
    flat = spark.createDataFrame([("a", i + 1, 1.0) for i in range(7)], "track_id string, lag int, value double")
    assert period.power_of_two(flat).first().L == 1


def test_fourier_equals_array_functions(spark):
    rng = random.Random(1)
    rows = [([rng.random() - 0.5 for _ in range(16)], [rng.random() - 0.5 for _ in range(16)]) for _ in range(20)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    both = df.select(C.circular_correlation(F.col("a"), F.col("b")).alias("x"), period.fourier_correlation("a", "b").alias("y")).collect()
    assert [r.x for r in both] == pytest.approx([r.y for r in both])


def test_several_channels_add_up(spark):
    rng = random.Random(7)
    rows = [("a", b, c, [rng.random() - 0.5 for _ in range(12)] if c < 2 else [0.0] * 12) for b in range(12) for c in range(3)]
    df = spark.createDataFrame(rows, "track_id string, bar int, channel int, frames array<double>")
    assert period.multichannel_period(df).first().L in (1, 2, 4, 8)
    a, b = ([r[3] for r in rows if r[1] == k] for k in (0, 1))
    pair = spark.createDataFrame([(a, b)], "a array<array<double>>, b array<array<double>>")
    got = pair.select(period.channel_correlation("a", "b")).first()[0]
    dots = [sum(x[c][i] * y for c in range(2) for i, y in zip([(j + s) % 12 for j in range(12)], b[c], strict=True)) for x in [a] for s in range(12)]
    scale = sum((sum(v * v for v in a[c]) * sum(v * v for v in b[c])) ** 0.5 for c in range(2))
    assert got == pytest.approx(max(dots) / scale)


def test_zip_reports_unequal_counts(spark):
    def part(n, name):
        return spark.createDataFrame([("d", i, f"{name}{i}") for i in range(n)] + [("e", 0, name)], f"dataset string, position int, {name} string")

    rows, bad = prep.zipped(part(3, "f"), part(3, "a"), part(2, "n"))
    assert rows.count() == 3 and [r.dataset for r in bad.collect()] == ["d"]


def test_mixed_channels_keep_the_sum(spark):
    rows = spark.createDataFrame([(i, *([float(i + c)] for c in range(5))) for i in range(200)], "id int, c0 array<double>, c1 array<double>, c2 array<double>, c3 array<double>, c4 array<double>")
    got = prep.mixed_channels(rows, "id", [f"c{i}" for i in range(5)]).collect()
    assert all(sum(x[0] for x in r.mix) == 5 * r.id + 10 for r in got)
    assert {len(r.mix) for r in got} == {2, 3, 4, 5}


def test_loop_tempos_and_full_bars(spark):
    rows = spark.createDataFrame([("a", i, float(i), i + 1.0, b) for i, b in enumerate([120.0, 120.0, 120.0, 120.0, 121.0, 121.0])], "track_id string, bar int, start double, end double, tempo_bpm double")
    assert [(r.n_bars, r.mean_bpm) for r in loops.loop_tempos(rows, 4).orderBy("loop").collect()] == [(4, 120.0), (2, 121.0)]
    onsets = points(spark, [9.5 + 0.5 * i for i in range(8)])
    assert column(loops.events_in_full_bars(onsets, bars.bars(points(spark, [10, 12, 14, 16])), 9.0, 13.0), "t", "t") == [10.0, 10.5, 11.0, 11.5]


def test_validity_and_improvement(spark):
    rows = [("ok", 0, 0.0), ("ok", 1, 2.0), ("ok", 2, 4.0), ("one", 0, 0.0), ("bad", 0, 0.0), ("bad", 1, 2.0), ("bad", 2, 1.0)]
    got = {r.track_id: (r.valid, r.message) for r in bars.validity(spark.createDataFrame(rows, "track_id string, position int, t double")).collect()}
    assert got == {"ok": (True, ""), "one": (False, "Not enough downbeats: 1 < 2"), "bad": (False, "Downbeats are not monotonically increasing")}
    df = spark.createDataFrame([(100.0, 50.0), (50.0, 100.0), (0.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(C.improvement(F.col("a"), F.col("b"))).collect()] == [50.0, -100.0, 0.0]


def test_long_grid_keeps_rows_and_wide_has_one(spark):
    onsets = points(spark, [0.05, 0.5, 1, 1.5, 2.05, 2.5, 3, 3.5, 4.05])
    long = grid.grid_long(bars.bars(points(spark, [0, 2, 4, 6, 8])), onsets)
    wide = grid.grid_wide(long, ["uncorrected", "standard_L2"])
    assert wide.count() == wide.select("bar", "tick").distinct().count() == 64
    rms = {r.method: r for r in stats.rms(long).collect()}
    # three of nine onsets are late by a fortieth of a bar; after the shift by that the six others are early
    assert rms["uncorrected"].rms_phase == pytest.approx(0.025 * (3 / 9) ** 0.5)
    assert rms["per_snippet"].rms_phase == pytest.approx(0.025 * (6 / 9) ** 0.5)
    assert rms["uncorrected"].rms_ms == pytest.approx(rms["uncorrected"].rms_phase * 2000)


def test_folds_are_equal_and_seeded(spark):
    items = spark.createDataFrame([("d", i) for i in range(83)] + [("t", i) for i in range(9)], "dataset string, item int")
    a, b = ({(r.dataset, r.item, r.fold) for r in prep.folds(items, everywhere=("t",)).collect()} for _ in range(2))
    assert a == b
    sizes = [sum(f == k and d == "d" for d, _, f in a) for k in range(8)]
    assert sizes == [10] * 7 + [13]
    roles = prep.roles(prep.folds(items, everywhere=("t",)))
    assert {r.role for r in roles.where("dataset = 't'").collect()} == {"test"}


def test_empty_tables_pass(spark):
    none = points(spark, [])
    rows = bars.bars(none)
    assert grid.grid_long(rows, none).count() == 0 and bars.corrected_bars(rows).count() == 0
    assert period.onset_period(none, rows).count() == 0 and series.min_spacing(none, 1.0).count() == 0
    assert reports.not_done(none.select("track_id"), none).count() == 0
