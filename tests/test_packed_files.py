"""Text formats with many tracks in a file, against the same tracks in files of their own."""

import glob
import os

import pytest

import __spark_entry__ as entry
from timegrid.plans import formats
from timegrid.sources import files, scratch

HEAD = "corrected_bar_num\tbar_num\tstart\tnext\tduration_s\ttempo_bpm\tusable\tbpm_threshold\taction\tremoved\tinserted\n"


def test_many_tracks_in_a_file(spark, tmp_path):
    onsets = spark.createDataFrame([(k, k + i / 8) for k in range(40) for i in range(5)], "track_id long, t double").coalesce(1)
    files.write_onsets(onsets, f"{tmp_path}/o")
    assert len(glob.glob(f"{tmp_path}/o/*.csv")) == 1
    assert sorted(map(tuple, files.read_onsets(spark, f"{tmp_path}/o").collect())) == sorted((str(r.track_id), r.t) for r in onsets.collect())
    files.packed(onsets, 60).csv(f"{tmp_path}/p")
    assert len(glob.glob(f"{tmp_path}/p/*.csv")) == 4 and files.read_onsets(spark, f"{tmp_path}/p").count() == 200


def test_metadata_of_many_tracks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# 7\ttime_signature=3\n# 7\ttime_signature=5\n# 8\tother = x=y\ntrack_id\t" + HEAD + "7\t1\t1|2\t0.0\t2.0\t2.0\t120.00\t1\tnone\tmerged\t1.0\t\n8\t1\t1\t0.0\t2.0\t2.0\t120.00\t0\tnone\tunchanged\t\t\n")
    rows, meta = files.read_corrected(spark, str(tmp_path))
    assert sorted((r.track_id, r.bar_num, r.usable) for r in rows.collect()) == [("7", [1, 2], True), ("8", [1], False)]
    assert {r.track_id: (r.time_signature, r.meta) for r in meta.collect()} == {"7": (3, {"time_signature": "3"}), "8": (4, {"other": "x=y"})}


def test_wide_lines_say_their_track(spark, tmp_path):
    (tmp_path / "a.csv").write_text("track_id,bar_number,tick_16th,phase_drum(L=2)\nx,0,1,0.5\ny,0,1,0.25\n")
    got = {(r.track_id, r.phase) for r in files.read_wide(spark, str(tmp_path), ("bar_number", "tick_16th")).collect()}
    assert got == {("x", 0.5), ("y", 0.25)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", ["source_beats", "corrected_text", "corrected_metadata", "onset_files", "value_files", "batch_summary"])
def test_files_go_with_rows(spark, name, monkeypatch):
    """15 tracks, but no folder for any of them."""
    made, own = [], scratch.folder
    monkeypatch.setattr(formats.scratch, "folder", lambda s, n: made.append(own(s, n)) or made[-1])
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert made and all(not os.path.isdir(e) for p in made for e in glob.glob(f"{p.removeprefix('file:')}/*"))
