"""Snippets, loops and exports: window tempos, loop bounds, events in loops, event lists, bar durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timegrid.functions import cols as C
from timegrid.functions.cols import by_track
from timegrid.operators import asof


def windows(tracks: DataFrame, overview: DataFrame | None = None, start: float | None = None, duration: float | None = None, default_start: float = 0.0, default_duration: float = 30.0) -> DataFrame:
    """A window per track: a given start, else the overview's (track_id, offset_s), else the default; likewise its length."""
    rows = tracks.select("track_id").distinct()
    rows = rows.join(overview.select("track_id", "offset_s"), "track_id", "left") if overview is not None else rows.withColumn("offset_s", F.lit(None).cast("double"))
    w = F.coalesce(F.lit(start).cast("double"), F.col("offset_s"), F.lit(default_start))
    return rows.select("track_id", w.alias("w_start"), (w + F.coalesce(F.lit(duration).cast("double"), F.lit(default_duration))).alias("w_end"))


def overlapping(bars: DataFrame, windows_: DataFrame, width: float | None = None) -> DataFrame:
    """Pairs of a bar and a window of its track that overlap.

    width: for many windows a track, the length of the time bins that both sides are dealt over. A pair is found in the
    bin of the later of its starts, so once, and no track's bars meet all its windows.
    """
    meet = "start < w_end AND end > w_start"
    if width is None:
        return bars.join(windows_, "track_id").where(meet)

    def dealt(df: DataFrame, low: str, high: str) -> DataFrame:
        first, last = (F.floor(F.col(c) / width) for c in (low, high))
        return df.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(first, last)))

    pairs = dealt(bars, "start", "end").join(dealt(windows_, "w_start", "w_end"), ["track_id", "_bin"])
    return pairs.where(meet).where(F.col("_bin") == F.floor(F.greatest("start", "w_start") / width)).drop("_bin")


def starting_inside(bars: DataFrame, windows_: DataFrame) -> DataFrame:
    """The bars that start in [w_start, w_end); their numbers and flags stay."""
    return bars.join(windows_, "track_id").where("start >= w_start AND start < w_end")


def window_in_bars(bars: DataFrame, windows_: DataFrame) -> DataFrame:
    """The window's edges as bar numbers, half a bar out on both sides; null if no bar starts in it."""
    inside = starting_inside(bars, windows_).groupBy("track_id").agg((F.min("bar") - 0.5).alias("left"), (F.max("bar") + 0.5).alias("right"))
    return windows_.select("track_id").join(inside, "track_id", "left")


def snippet_tempo(bars: DataFrame, windows_: DataFrame) -> DataFrame:
    return overlapping(bars, windows_).groupBy("track_id").agg(F.count(F.lit(1)).alias("n_bars"), F.avg("tempo_bpm").alias("mean_bpm"))


def loop_tempos(bars: DataFrame, length: int) -> DataFrame:
    """Mean tempo of consecutive groups of `length` bars; the last may have fewer."""
    position = F.row_number().over(by_track().orderBy("bar")) - 1
    rows = bars.withColumn("loop", F.floor(position / length).cast("int"))
    return rows.groupBy("track_id", "loop").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_bars"), F.avg("tempo_bpm").alias("mean_bpm"))


def track_summary(bars: DataFrame, windows_: DataFrame, length: int) -> DataFrame:
    """Mean tempo of a track's bars, of its window and of its loops, with counts."""
    whole = bars.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_bars"), F.avg("tempo_bpm").alias("global_bpm"))
    part = snippet_tempo(bars, windows_).select("track_id", F.col("n_bars").alias("snippet_bars"), F.col("mean_bpm").alias("snippet_bpm"))
    by_loop = loop_tempos(bars, length).groupBy("track_id").agg(F.count(F.lit(1)).alias("n_loops"), F.avg("mean_bpm").alias("loop_bpm"))
    rows = whole.join(part, "track_id", "left").join(by_loop, "track_id", "left")
    return rows.withColumn("snippet_bars", F.coalesce("snippet_bars", F.lit(0)))


def export_tempo(bars: DataFrame, length: int, default: float = 120.0, snippet_first: str | None = None) -> DataFrame:
    """Mean tempo of the first `length` bars of the track, or from the column snippet_first on."""
    first = F.col(snippet_first) if snippet_first else F.lit(0)
    inside = (F.col("bar") >= first) & (F.col("bar") < first + length)
    return bars.groupBy("track_id").agg(F.coalesce(F.avg(F.when(inside, F.col("tempo_bpm"))), F.lit(default)).alias("export_bpm"))


def snippet_info(bars: DataFrame, windows_: DataFrame, patterns: DataFrame) -> DataFrame:
    """Full bars in the window: first start, last end, length, number, and complete loops by method as a map."""
    full = bars.join(windows_, "track_id").where("start >= w_start AND end <= w_end")
    info = full.groupBy("track_id").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.count(F.lit(1)).alias("n_bars")).withColumn("duration", F.col("last_end") - F.col("first_start"))
    done = info.select("track_id", "n_bars").join(patterns, "track_id").select("track_id", F.struct("method", F.floor(F.col("n_bars") / F.col("L")).cast("int").alias("loops")).alias("e"))
    maps = done.groupBy("track_id").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("complete_loops"))  # an entry per method
    return info.join(maps, "track_id", "left")


def bar_durations(starts: DataFrame) -> DataFrame:
    """Rows (track_id, bar, start): start from the first in ms, and length; the last length is the others' median."""
    order = by_track().orderBy("bar")
    length = (F.lead("start").over(order) - F.col("start")) * 1000.0
    rows = starts.withColumn("length", length).withColumn("begin_ms", (F.col("start") - F.min("start").over(by_track())) * 1000.0)
    return rows.select("track_id", "bar", "begin_ms", F.coalesce("length", F.percentile("length", 0.5).over(by_track())).alias("duration_ms"))


def bar_starts(long: DataFrame) -> DataFrame:
    """The first grid time that isn't null of each track, method and bar."""
    present = F.when(F.col("grid_time").isNotNull(), F.col("tick"))
    return long.groupBy("track_id", "method", "bar").agg(F.min_by("grid_time", present).alias("start"))


def duration_export(long: DataFrame, method: str = "uncorrected") -> DataFrame:
    """The bar-duration table: number, song id and info, first onset, start and length of each bar."""
    rows = bar_durations(bar_starts(long.where(F.col("method") == method)).drop("method").where("start IS NOT NULL"))
    first = long.where((F.col("method") == method)).groupBy("track_id").agg((F.min("onset_time") * 1000.0).alias("first_onset_ms"))
    name = F.col("track_id").cast("string")
    return rows.join(first, "track_id").select(F.col("bar").alias("bar_number"), C.song_id(name).alias("song_id"), C.song_info(name).alias("song_info"), "first_onset_ms", "begin_ms", "duration_ms")


def loop_bounds(long: DataFrame, length: int, steps: int = C.STEPS) -> DataFrame:
    """Per track and method: grid time of the first bar's first tick, and of the bar's `length` later; both must exist."""
    track = Window.partitionBy("track_id", "method")
    starts = long.groupBy("track_id", "method", "bar").agg(F.min(F.when(F.col("tick") == 0, F.col("grid_time"))).alias("start"))
    rows = starts.withColumn("b", F.col("bar") - F.min("bar").over(track))
    rows = rows.groupBy("track_id", "method").agg(F.min(F.when(F.col("b") == 0, F.col("start"))).alias("loop_start"), F.min(F.when(F.col("b") == length, F.col("start"))).alias("loop_end"))
    return rows.where("loop_start IS NOT NULL AND loop_end IS NOT NULL")


def first_ticks(long: DataFrame, length: int, steps: int = C.STEPS) -> DataFrame:
    """The first length * steps grid times of each track and method."""
    order = Window.partitionBy("track_id", "method").orderBy("bar", "tick")
    return long.where("grid_time IS NOT NULL").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= length * steps).drop("_n")


def events_in_loops(onsets: DataFrame, bounds: DataFrame) -> DataFrame:
    """Onsets in [loop_start, loop_end) of each bound: one bound per track and method, so the join is on the track."""
    return onsets.join(bounds, "track_id").where("t >= loop_start AND t < loop_end").withColumn("offset", F.col("t") - F.col("loop_start"))


def events_in_full_bars(onsets: DataFrame, bars: DataFrame, low: float, high: float) -> DataFrame:
    """The onsets inside those bars that lie in [low, high] as a whole."""
    return asof.in_bars(onsets, bars.select("track_id", "bar", "start", "end").where((F.col("start") >= low) & (F.col("end") <= high))).drop("start", "end")


def delta_ticks(events: DataFrame, ticks_per_unit: float, length: int, end: Column | None = None) -> DataFrame:
    """Events (track_id, t) as on and off messages with the ticks since the message before.

    Times count from the track's first event. A note lasts `length` ticks, cut at `end` (a Column of ticks) if given.
    """
    start = F.floor((F.col("t") - F.min("t").over(by_track())) * ticks_per_unit).cast("long")
    rows = events.withColumn("tick", start)
    stop = F.col("tick") + length
    rows = rows.withColumn("stop", F.greatest(F.least(stop, end), F.col("tick")) if end is not None else stop)
    order = by_track().orderBy("t", *[c for c in ("event_id",) if c in events.columns])
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("on", F.greatest(F.lit(0), F.col("tick") - F.coalesce(F.lag("stop").over(order), F.lit(0))))
    message = F.explode(F.array(F.struct(F.lit("on").alias("kind"), F.col("on").alias("delta")), F.struct(F.lit("off").alias("kind"), (F.col("stop") - F.col("tick")).alias("delta"))))
    return rows.select("track_id", "n", message.alias("m")).select("track_id", "n", "m.kind", "m.delta")


def interval_ticks(intervals: DataFrame, ticks_per_unit: float) -> DataFrame:
    """Intervals (track_id, note, start, end) as on and off messages, ticks since the message before."""
    base = F.min("start").over(by_track())
    rows = intervals.withColumn("a", F.floor((F.col("start") - base) * ticks_per_unit).cast("long")).withColumn("b", F.floor((F.col("end") - base) * ticks_per_unit).cast("long"))
    order = by_track().orderBy("start", "note")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("on", F.greatest(F.lit(0), F.col("a") - F.coalesce(F.lag("b").over(order), F.lit(0))))
    message = F.explode(F.array(F.struct(F.lit("on").alias("kind"), F.col("on").alias("delta")), F.struct(F.lit("off").alias("kind"), (F.col("b") - F.col("a")).alias("delta"))))
    return rows.select("track_id", "n", "note", message.alias("m")).select("track_id", "n", "note", "m.kind", "m.delta")


def paired_tempos(raw: DataFrame, fixed: DataFrame) -> DataFrame:
    """Raw and corrected bars side by side by position; the shorter table is padded with nulls."""
    order = by_track().orderBy("start")
    a = raw.select("track_id", F.row_number().over(order).alias("bar_num"), F.col("start").alias("downbeat_raw"), F.col("tempo_bpm").alias("tempo_raw"))
    b = fixed.select("track_id", F.row_number().over(order).alias("bar_num"), F.col("start").alias("downbeat_corrected"), F.col("tempo_bpm").alias("tempo_corrected"), "usable")
    return a.join(b, ["track_id", "bar_num"], "full").withColumn("usable", F.coalesce("usable", F.lit(False)))
