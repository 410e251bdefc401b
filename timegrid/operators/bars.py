"""Bars from boundaries: tempo, time signature, repair of half- and double-rate boundaries, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timegrid.functions import cols as C
from timegrid.functions.cols import by_track
from timegrid.operators.ranges import Cuts

MANY = 135.0


def strict_downbeats(beats: DataFrame) -> DataFrame:
    """Distinct downbeat times of beats that lie in a bar at its first place."""
    return beats.where("bar_num >= 1 AND beat_pos = 1").select("track_id", F.col("downbeat_time").alias("t")).distinct()


def bars(boundaries: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """Consecutive boundaries as bars: track_id, bar (from 0), start, end; times that repeat count once."""
    order = by_track().orderBy("t")
    rows = boundaries.select("track_id", "t").distinct()
    if cuts:
        rows = cuts.numbered(cuts.lead(cuts.placed(rows, "t"), "t", ["t"], "end"), ["t"], "bar")
        return rows.where("end IS NOT NULL").select("track_id", (F.col("bar") - 1).cast("int").alias("bar"), F.col("t").alias("start"), "end")
    rows = rows.select("track_id", (F.row_number().over(order) - 1).alias("bar"), F.col("t").alias("start"), F.lead("t").over(order).alias("end"))
    return rows.where("end IS NOT NULL")


def tied_bars(boundaries: DataFrame) -> DataFrame:
    """As bars, but boundaries of equal time (told apart by `tie`) stay and make bars of no length."""
    order = by_track().orderBy("t", "tie")
    rows = boundaries.select("track_id", (F.row_number().over(order) - 1).alias("bar"), F.col("t").alias("start"), F.lead("t").over(order).alias("end"))
    return rows.where("end IS NOT NULL")


def tempos(rows: DataFrame, beats: int | Column = 4) -> DataFrame:
    duration = F.col("end") - F.col("start")
    return rows.withColumn("duration_s", duration).withColumn("tempo_bpm", C.bar_tempo(duration, beats))


def positive_tempos(rows: DataFrame, beats: int = 4) -> DataFrame:
    """Tempos of bars that have a length; the others are left out."""
    return tempos(rows.where("end - start > 0"), beats)


def listed_tempos(rows: DataFrame, beats: int = 4) -> DataFrame:
    """Tempos to two decimals; bars without length keep their row, with no tempo."""
    duration = F.col("end") - F.col("start")
    return rows.withColumn("tempo_bpm", F.when(duration > 0, F.round(F.lit(60.0) / duration * beats, 2)))


def time_signature(beats: DataFrame, default: int = 4) -> DataFrame:
    """The most frequent number of beats in a bar; of equally frequent ones that seen first. Bar 0 doesn't count."""
    per_bar = beats.where("bar_num >= 1").groupBy("track_id", "bar_num").agg(F.max("beat_pos").alias("n"))
    counted = per_bar.groupBy("track_id", "n").agg(F.count(F.lit(1)).alias("c"), F.min("bar_num").alias("first"))
    best = counted.groupBy("track_id").agg(F.max_by("n", F.struct("c", -F.col("first"))).alias("time_signature"))
    tracks = beats.select("track_id").distinct()
    return tracks.join(best, "track_id", "left").withColumn("time_signature", F.coalesce("time_signature", F.lit(default)))


def bars_by_resets(beats: DataFrame) -> DataFrame:
    """Bar numbers for beats that only have positions (track_id, beat_time, beat_pos): a bar begins at each 1."""
    run = by_track().orderBy("beat_time").rowsBetween(Window.unboundedPreceding, 0)
    return beats.withColumn("bar_num", F.sum((F.col("beat_pos") == 1).cast("int")).over(run).cast("int"))


def track_classes(rows: DataFrame, many: float = MANY) -> DataFrame:
    """Bars with tempo, class and the track's base, override, dominant class and orientation.

    If more than half of a track's bars are faster than `many`, half the median of those is the base instead.
    """
    median = F.percentile("tempo_bpm", 0.5)
    fast = F.when(F.col("tempo_bpm") > many, F.col("tempo_bpm"))
    base = rows.groupBy("track_id").agg(median.alias("base"), F.count(F.lit(1)).alias("n"), F.count(fast).alias("n_fast"), F.percentile(fast, 0.5).alias("fast"))
    base = base.withColumn("override", F.when(F.col("n_fast") * 2 > F.col("n"), F.col("fast") / 2.0)).select("track_id", "base", "override")
    joined = rows.join(base, "track_id").withColumn("class", C.tempo_class(F.col("tempo_bpm"), F.coalesce("override", "base")))

    def number(kind: str) -> Column:
        return F.sum((F.col("class") == kind).cast("int")).over(by_track())

    joined = joined.withColumn("dominant", F.when(number("normal") >= number("double") + number("half"), "normal").otherwise("factor2"))
    return joined.withColumn("orientation", F.when(F.col("dominant") == "normal", "").when(number("double") >= number("half"), "double").otherwise("half"))


def repaired(classed: DataFrame) -> DataFrame:
    """The corrected bars of classed bars.

    A bar to merge takes the next bar in, whatever that is; a bar to split becomes two halves; a track's last bar can't
    be merged. In a run of bars to merge, every second one has been taken in by its neighbour; so is the bar after a
    run of odd length.
    """
    order = by_track().orderBy("bar")
    rows = classed.withColumn("action", C.repair_action(F.col("class"), F.col("dominant"), F.col("orientation")))
    merge = F.col("action") == "merge"
    rows = rows.withColumn("island", F.sum((~merge).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = F.sum(merge.cast("int")).over(Window.partitionBy("track_id", "island").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("head", merge & (in_run % 2 == 1))
    rows = rows.withColumn("taken", F.coalesce(F.lag("head").over(order), F.lit(False))).withColumn("next_end", F.lead("end").over(order)).withColumn("next_bar", F.lead("bar").over(order))
    rows = rows.where(~F.col("taken"))
    middle = (F.col("start") + F.col("end")) / 2.0
    none = F.lit(None).cast("double")
    one, source = F.col("bar") + 1, F.array(F.col("bar") + 1)

    def piece(start: Column, action: str, bars_: Column, removed: Column, inserted: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(action).alias("action"), bars_.alias("bar_num"), removed.alias("removed"), inserted.alias("inserted"))

    start = F.col("start")
    parts = (
        F.when(F.col("head") & F.col("next_bar").isNotNull(), F.array(piece(start, "merged", F.array(one, one + 1), F.col("end"), none)))
        .when(F.col("head"), F.array(piece(start, "merge_impossible_tail", source, none, none)))
        .when(F.col("action") == "split", F.array(piece(start, "split_A", source, none, middle), piece(middle, "split_B", source, none, middle)))
        .otherwise(F.array(piece(start, "unchanged", source, none, none)))
    )
    stop = F.when(F.col("head"), F.coalesce("next_end", "end")).otherwise(F.col("end"))
    keep = ["track_id", "base", "override", "dominant", "orientation"]
    pieces = rows.select(*keep, stop.alias("stop"), F.explode(parts).alias("p")).select(*keep, "stop", "p.*")
    by_time = by_track().orderBy("start")
    out = pieces.withColumn("end", F.coalesce(F.lead("start").over(by_time), F.col("stop"))).withColumn("corrected_bar_num", F.row_number().over(by_time))
    return out.drop("stop")


def corrected_bars(rows: DataFrame, beats: int = 4, share: float = 0.10, many: float = MANY) -> DataFrame:
    """Repair of a track's bars from end to end: tempo, class, repair, tempo again, usable flag and threshold."""
    fixed = tempos(repaired(track_classes(tempos(rows, beats), many)), beats)
    base = C.usable_base(F.col("base"), F.col("dominant"), F.col("orientation"), F.col("override"))
    fixed = fixed.withColumn("usable_base_bpm", base).withColumn("usable", C.within_percent(F.col("tempo_bpm"), base, share))
    return fixed.withColumn("bpm_threshold", F.when(F.col("override").isNotNull(), F.lit(str(many))).otherwise(F.lit("none")))


def correction_statistics(rows: DataFrame, fixed: DataFrame) -> DataFrame:
    """A row per track: numbers of raw, corrected and usable bars, mean tempos, dominant class."""
    raw = rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("raw_bars"))
    done = fixed.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("corrected_bars"), F.count_if("usable").alias("usable_bars"), F.avg("tempo_bpm").alias("mean_corrected"),
        F.coalesce(F.avg(F.when(F.col("usable"), F.col("tempo_bpm"))), F.avg("tempo_bpm")).alias("mean_usable"),
        F.first("dominant").alias("dominant"), F.first("orientation").alias("orientation"), F.first("usable_base_bpm").alias("usable_base_bpm"), F.first("bpm_threshold").alias("bpm_threshold"),
    )
    return raw.join(done, "track_id")


def global_tempo(rows: DataFrame) -> DataFrame:
    return rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_bars"), F.avg("tempo_bpm").alias("mean_bpm"))


def equal_width_histogram(rows: DataFrame, value: str, bins: int = 20, group: list[str] | None = None) -> DataFrame:
    """Counts of values in equal bins over the least and largest value of all; the last bin is closed.

    If all values are equal the range is half a unit to either side. group: series that share the edges.
    """
    group = group or []
    rows = rows.where(F.col(value).isNotNull())
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    joined = rows.join(F.broadcast(ends))  # one row
    bin_ = F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / float(bins))), F.lit(bins - 1)).cast("int")
    counted = joined.groupBy(*group, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0)))
    return counted.withColumn("percent", F.col("n") * 100.0 / total)


def validity(boundaries: DataFrame) -> DataFrame:
    """Per track (rows track_id, position, t): whether there are two boundaries at least and they increase strictly."""
    order = by_track().orderBy("position")
    steps = boundaries.withColumn("step", F.col("t") - F.lag("t").over(order))
    seen = steps.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("least"))
    few = F.col("n") < 2
    bad = F.coalesce(F.col("least") <= 0, F.lit(False))
    message = F.when(few, F.concat(F.lit("Not enough downbeats: "), F.col("n").cast("string"), F.lit(" < 2"))).when(bad, "Downbeats are not monotonically increasing").otherwise("")
    return seen.select("track_id", (~few & ~bad).alias("valid"), message.alias("message"))


def outliers(rows: DataFrame, value: str, n_std: float = 2.0) -> DataFrame:
    """Flags values no farther from the track's mean than n population standard deviations."""
    keep = F.abs(F.col(value) - F.avg(value).over(by_track())) <= n_std * F.stddev_pop(value).over(by_track())
    return rows.withColumn("kept", keep)
