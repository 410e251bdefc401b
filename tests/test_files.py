"""Readers and writers by round trips on small files."""

import json

import pytest

from timegrid.operators import bars, reports
from timegrid.sources import files


def test_text_formats(spark, tmp_path):
    (tmp_path / "song.tsv").write_text("beat_time(s)\tdownbeat_time(s)\tbeat_pos\tglobal_beat\tbar_num\n0.5\t0.0\t0\t1\t0\n1.0\t1.0\t1\t2\t1\n")
    beats = files.read_beats(spark, str(tmp_path / "song.tsv"))
    assert [(r.track_id, r.beat_time, r.bar_num) for r in beats.orderBy("beat_time").collect()] == [("song", 0.5, 0), ("song", 1.0, 1)]
    (tmp_path / "bad.tsv").write_text("beat_time(s)\tx\n0.5\t0\n")
    with pytest.raises(ValueError):
        files.read_beats(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "o.csv").write_text("time\n1.5\nx\n0.5\n")
    assert sorted(r.t for r in files.read_onsets(spark, str(tmp_path / "o.csv")).collect()) == [0.5, 1.5]
    (tmp_path / "overview.csv").write_text(" Song_ID ;SongName; Corrected Offset (ms)\n12;My Song;1500\n13;Other;\n")
    rows = {r.song_id: (r.songname, r.offset) for r in files.read_overview(spark, str(tmp_path / "overview.csv")).collect()}
    assert rows == {"12": ("My Song", 1.5), "13": ("Other", None)}


def test_corrected_bars_and_metadata(spark, tmp_path):
    head = "corrected_bar_num\tbar_num\tstart\tnext\tduration_s\ttempo_bpm\tusable\tbpm_threshold\taction\tremoved\tinserted\n"
    (tmp_path / "a.txt").write_text("# time_signature=3\n# dominant_major=normal\n" + head + "1\t1|2\t0.0\t2.0\t2.0\t120.00\t1\tnone\tmerged\t1.000000\t\n")
    rows, meta = files.read_corrected(spark, str(tmp_path / "a.txt"))
    r = rows.first()
    assert (r.bar_num, r.usable, r.removed, r.inserted) == ([1, 2], True, 1.0, None)
    assert meta.first().time_signature == 3


def test_results_skip_broken_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.json").write_text(json.dumps({"track_id": "one", "correction": {"raw_bars": 60, "corrected_bars": 59}, "errors": []}, indent=1))
    (tmp_path / "x" / "two.json").write_text(json.dumps({"correction": {"raw_bars": 5, "corrected_bars": 5}, "errors": ["e"]}, indent=1))
    (tmp_path / "x" / "broken.json").write_text("{")
    summary = reports.batch_summary(files.read_results(spark, str(tmp_path)))
    assert {(r.track_id, r.raw_bars, r.ok) for r in summary.collect()} == {("one", 60, True), ("two", 5, False)}
    assert tuple(reports.outcome_counts(summary).first()) == (2, 1, 1)


def test_wide_to_long(spark):
    wide = spark.createDataFrame([(1, 0, 0.1, 2.0, float("nan"))], "bar_number int, tick_16th int, `phase_drum(L=4)` double, `grid_time_drum(L=4)` double, phase_uncorrected double")
    rows = {r.method: (r.L, r.phase, r.grid_time) for r in files.wide_to_long(wide, ("bar_number", "tick_16th")).collect()}
    assert rows == {"drum": (4, 0.1, 2.0), "uncorrected": (None, None, None)}


def test_versions_keep_backups(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    files.write_version(spark.range(3), path)
    files.write_version(files.current(spark, path).where("id > 0"), path)
    assert files.current(spark, path).count() == 2
    assert spark.read.parquet(f"{path}/version=000001").count() == 3


def test_discovery(spark, tmp_path):
    for name in ("12_a.wav", "40_b.wav", "x_c.wav", "._12_a.wav"):
        (tmp_path / name).write_text("x")
    found = files.discover(spark, str(tmp_path), r"^([^_]+)_", 1, 20)
    assert [r["name"] for r in found.collect()] == ["12_a.wav"]


def test_corrected_writer(spark, tmp_path):
    rows = bars.bars(spark.createDataFrame([("a", float(t)) for t in (0, 2, 4, 5, 6, 8)], "track_id string, t double"))
    fixed = bars.corrected_bars(rows)
    files.write_corrected(fixed, bars.correction_statistics(rows, fixed), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/bars").count() == fixed.count()
    assert files.text_of_corrected(fixed).first().start == "0.000000"


def test_files_of_unlike_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("bar_number,tick_16th,phase_drum(L=4),grid_time_drum(L=4)\n1,0,0.25,2.0\n")
    (tmp_path / "b.csv").write_text("tick_16th,phase_drum(L=2),bar_number\n3,0.5,7\n")
    got = {(r.track_id, r.method, r.L, r.bar_number, r.tick_16th, r.phase, r.grid_time) for r in files.read_wide(spark, f"{tmp_path}/*.csv", ("bar_number", "tick_16th")).collect()}
    assert got == {("a", "drum", 4, 1.0, 0.0, 0.25, 2.0), ("b", "drum", 2, 7.0, 3.0, 0.5, None)}
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "x.csv").write_text("n,onset_times\n1,0.5\n2,1.5\n")
    (tmp_path / "o" / "y.csv").write_text("onset_time,n\n2.5,9\n")
    (tmp_path / "o" / "z.csv").write_text("time\n3.5\n")
    got = {(r.track_id, r.t) for r in files.read_onsets(spark, f"{tmp_path}/o/*.csv").collect()}
    assert got == {("x", 0.5), ("x", 1.5), ("y", 2.5), ("z", 3.5)}


def test_quoted_cells_short_lines_and_unlike_headers(spark, tmp_path):
    """A row with a separator or line end inside quotes stays one row, and its numbers stay."""
    (tmp_path / "on").mkdir()
    (tmp_path / "on" / "a.csv").write_text('note,onset_times\n"a,b",1.5\n"two\nlines",2.5\nx\n')
    (tmp_path / "on" / "b.csv").write_text('onset_time,"x, y"\n3.5,"q ""r"""\n')
    (tmp_path / "on" / "c.csv").write_text("4.5\n5.5,z\n")
    assert sorted((r.track_id, r.t) for r in files.read_onsets(spark, f"{tmp_path}/on").collect()) == [("a", 1.5), ("a", 2.5), ("b", 3.5), ("c", 4.5), ("c", 5.5)]
    (tmp_path / "ov").mkdir()
    (tmp_path / "ov" / "a.csv").write_text('Song ID;Song Name;Offset (ms)\n1;"A; B";1500\n2\n')
    (tmp_path / "ov" / "b.csv").write_text(" offset ; note ; song_id \n2,5;x;3\n")
    assert sorted(map(tuple, files.read_overview(spark, f"{tmp_path}/ov").collect())) == [("1", "A; B", 1.5), ("2", None, None), ("3", None, 0.0025)]
    (tmp_path / "le").mkdir()
    (tmp_path / "le" / "a.csv").write_text('name,L\n"x,1",4\ny,-\n')
    (tmp_path / "le" / "b.csv").write_text("track,bars,more\nz,2,9\nw\n")
    assert sorted(map(tuple, files.read_lengths(spark, f"{tmp_path}/le").collect())) == [("x,1", 4), ("z", 2)]
    (tmp_path / "wi").mkdir()
    (tmp_path / "wi" / "a.csv").write_text("bar_number,tick_16th,phase_drum(L=2),grid_time_drum(L=2)\n0,1,0.5,1.5\n0,2,0.25\n")
    (tmp_path / "wi" / "b.csv").write_text('"grid_time_mel(L=4)",bar_number\n7.5,3\n')
    got = sorted(((r.track_id, r.bar_number, r.tick_16th, r.method, r.L, r.phase, r.grid_time) for r in files.read_wide(spark, f"{tmp_path}/wi", ("bar_number", "tick_16th")).collect()), key=str)
    assert got == [("a", 0.0, 1.0, "drum", 2, 0.5, 1.5), ("a", 0.0, 2.0, "drum", 2, 0.25, None), ("b", 3.0, None, "mel", 4, None, 7.5)]


def test_repeated_keys_of_metadata(spark, tmp_path):
    head = "corrected_bar_num\tbar_num\tstart\tnext\tduration_s\ttempo_bpm\tusable\tbpm_threshold\taction\tremoved\tinserted\n"
    (tmp_path / "a.txt").write_text("# time_signature=3\n# time_signature=5\n# other = x=y\n" + head + "1\t1\t0.0\t2.0\t2.0\t120.00\t1\tnone\tunchanged\t\t\n")
    _, meta = files.read_corrected(spark, str(tmp_path / "a.txt"))
    assert (meta.first().time_signature, meta.first().meta) == (3, {"time_signature": "3", "other": "x=y"})


def test_one_scan_and_no_join(spark, tmp_path):
    (tmp_path / "a.csv").write_text("bar_number,phase_x\n0,0.5\n")
    for rows in (files.read_wide(spark, str(tmp_path)), files.read_onsets(spark, str(tmp_path))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan text") == 1 and "Join" not in plan


def test_wide_rows_keep_their_methods(spark, tmp_path):
    """Rows without cells, rows that lack a method, and an empty grid."""
    wide = spark.createDataFrame(
        [("a", 0, 0.5, None, None, ["x", "y(L=2)"]), ("b", 0, 0.25, None, None, ["x"]), ("c", 0, None, None, 2.0, ["y(L=2)"])],
        "track_id string, bar_number int, phase_x double, `phase_y(L=2)` double, `grid_time_y(L=2)` double, held array<string>",
    )
    files.write_wide(wide, f"{tmp_path}/w", present="held")
    got = sorted((r.track_id, r.method, r.L or 0, r.phase, r.grid_time) for r in files.read_wide(spark, f"{tmp_path}/w", ("bar_number",)).collect())
    assert got == [("a", "x", 0, 0.5, None), ("a", "y", 2, None, None), ("b", "x", 0, 0.25, None), ("c", "y", 2, None, 2.0)]
    files.write_wide(wide.limit(0), f"{tmp_path}/e", present="held")
    assert files.read_wide(spark, f"{tmp_path}/e", ("bar_number",)).count() == 0
