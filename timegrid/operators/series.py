"""Value series and event lists: runs, gaps, spacing, peaks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timegrid.functions.cols import by_track
from timegrid.operators.ranges import RANGE, Cuts
from timegrid.sources import scratch


def differences(rows: DataFrame, value: str, order: str) -> DataFrame:
    return rows.withColumn("difference", F.col(value) - F.lag(value).over(by_track().orderBy(order)))


def voiced(values: DataFrame, low: float, high: float) -> DataFrame:
    """Values above 0 in [low, high)."""
    return values.where((F.col("t") >= low) & (F.col("t") < high) & (F.col("value") > 0))


def runs(rows: DataFrame, end: float | None = None, least: float = 0.0, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Consecutive rows (track_id, t, note) of one note as an interval up to the next run's start; the last ends at `end`.

    Without an end it ends at its last row. Intervals shorter than `least` are dropped.
    """
    by = by_track().orderBy(*order)
    new = F.coalesce(~F.col("note").eqNullSafe(F.lag("note").over(by)), F.lit(True)) | (F.row_number().over(by) == 1)
    marked = rows.withColumn("run", F.sum(new.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("track_id", "run", "note").agg(F.min("t").alias("start"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    stop = F.coalesce(F.lead("start").over(by_track().orderBy("run")), F.lit(end).cast("double"), F.col("last").cast("double"))
    return spans.withColumn("end", stop).where(F.col("end") - F.col("start") >= least).drop("last")


def gap_fill(points: DataFrame, expected: float, ratio: float = 2.0) -> DataFrame:
    """Points (track_id, t) and those put into gaps longer than ratio * expected, spaced by `expected`."""
    gap = F.col("t") - F.lag("t").over(by_track().orderBy("t"))
    rows = points.select("track_id", "t", gap.alias("gap"))
    wide = rows.where(F.col("gap") > ratio * expected).withColumn("n", (F.rint(F.col("gap") / expected) - 1).cast("int")).where("n >= 1")
    added = wide.select("track_id", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.col("t") - F.col("gap") + i * expected)).alias("t"), F.lit(True).alias("added"))
    return rows.select("track_id", "t", F.lit(False).alias("added")).unionByName(added)


def min_spacing(points: DataFrame, least: float) -> DataFrame:
    """Greedy minimum spacing in each track: kept points are at least `least` after the last kept one.

    A task scans its tracks in order and holds the last kept time alone, so a track may be of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, track, last = False, None, 0.0
        for batch in batches:
            kept = []
            for i, (x, t) in enumerate(zip(batch.column("track_id").to_pylist(), batch.column("t").to_pylist(), strict=True)):
                if not began or x != track or not t - last < least:
                    began, track, last = True, x, t
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    rows = points.select("track_id", F.col("t").cast("double").alias("t")).where("t IS NOT NULL").repartition("track_id").sortWithinPartitions("track_id", "t")
    return rows.mapInArrow(run, rows.schema)


def min_spacing_in_ranges(points: DataFrame, least: float, cuts: Cuts, keep: Callable[[DataFrame, str], DataFrame] = scratch.written) -> DataFrame:
    """As min_spacing for `least` above 0, over any number of tasks for a track.

    Every point jumps to the first one at least `least` later, and so into another cell of time, as cells are half as
    wide. Two neighbouring blocks of cells make a block twice as wide, and jumps that stay in it are joined with the
    next ones: then each leaves its block. Only points at which jumps enter a block are needed further on, and these lie
    in its first `least`, so tables shrink about as blocks grow. From the first point of a track, the jumps of the widest
    blocks and then of ever narrower ones reach all that stay. There are two joins by track and time for each width, about
    2 log2(n) for chains of n points.
    """
    rows = cuts.placed(points.select("track_id", F.col("t").cast("double").alias("t")).where("t IS NOT NULL").distinct(), "t")
    followed = keep(cuts.lead(rows, "t", ["t"], "after").drop(RANGE), "points")
    there, none = F.struct("t", "after"), F.lit(None).cast("struct<t: double, after: double>")
    ahead = followed.select("track_id", F.col("t").alias("_t"), F.lit(1).alias("_kind"), there.alias("_to"), none.alias("_from"))
    # looked for a little early, then tested as the scan does, by the difference
    early = F.col("t") + least - F.abs(F.col("t") + least) * 1e-12
    wanted = followed.select("track_id", early.alias("_t"), F.lit(0).alias("_kind"), none.alias("_to"), there.alias("_from"))
    found = cuts.first(cuts.placed(ahead.unionByName(wanted), "_t"), "_to", ["_t", "_kind"], "_next").where("_kind = 0 AND _next IS NOT NULL")
    place = F.when(F.col("_next.t") - F.col("_from.t") >= least, F.col("_next.t")).otherwise(F.col("_next.after"))
    lowest = followed.agg(F.min("t")).first()[0]

    def bits(a: str, b: str):
        """Blocks of 2 ** bits cells are the narrowest that hold both times."""
        first, second = (F.floor((F.col(c) - F.lit(lowest)) / (least / 2)) for c in (a, b))
        return F.length(F.bin(first.bitwiseXOR(second))).alias("bits")

    first = keep(followed.groupBy("track_id").agg(F.min("t").alias("t")), "first")
    jumps = found.select("track_id", F.col("_from.t").alias("t"), place.alias("to")).where("to IS NOT NULL")
    jumps = keep(jumps.select("*", bits("t", "to")), "jumps")
    steps = []
    while (width := jumps.agg(F.min("bits")).first()[0]) is not None:
        inside = jumps.where(F.col("bits") == width)
        steps.append(inside.select("track_id", "t", "to"))
        entered = jumps.where(F.col("bits") > width).select("track_id", F.col("to").alias("t")).unionByName(first).distinct()
        then = jumps.select("track_id", F.col("t").alias("to"), F.col("to").alias("_to"))
        own = jumps.join(entered, ["track_id", "t"], "left_semi")
        longer = own.where(F.col("bits") == width).join(then, ["track_id", "to"]).select("track_id", "t", F.col("_to").alias("to"))
        jumps = keep(own.where(F.col("bits") > width).unionByName(longer.select("*", bits("t", "to"))), "jumps")
    reached = first
    for step in reversed(steps):
        reached = keep(reached.unionByName(reached.join(step, ["track_id", "t"]).select("track_id", F.col("to").alias("t"))), "reached")
    return reached


def peak_normalised(values: DataFrame) -> DataFrame:
    """value over the track's largest absolute value; unchanged where that is 0."""
    top = F.max(F.abs("value")).over(by_track())
    return values.withColumn("value", F.when(top > 0, F.col("value") / F.nullif(top, F.lit(0.0))).otherwise(F.col("value")))


def peaks(values: DataFrame, delta: float) -> DataFrame:
    """Strict local maxima of a track's values that reach delta."""
    order = by_track().orderBy("t")
    rows = values.withColumn("_a", F.lag("value").over(order)).withColumn("_b", F.lead("value").over(order))
    return rows.where((F.col("value") > F.col("_a")) & (F.col("value") > F.col("_b")) & (F.col("value") >= delta)).drop("_a", "_b")


def refined_peaks(candidates: DataFrame, values: DataFrame, before: float, after: float) -> DataFrame:
    """Each candidate (track_id, t) moved to the largest absolute value in [t - before, t + after], the earliest of equals.

    A range join by buckets as wide as the window: a sample goes to its own bucket, a candidate to the buckets that its
    window touches, so keys are (track, bucket) and no track meets itself as a whole. Without samples a candidate stays.
    """
    width = before + after
    bucket = F.floor(F.col("t") / width)
    samples = values.select("track_id", bucket.alias("bucket"), F.col("t").alias("s"), F.abs("value").alias("v"))
    asked = candidates.select("track_id", "t").distinct().withColumn("bucket", F.explode(F.sequence(F.floor((F.col("t") - before) / width), F.floor((F.col("t") + after) / width))))
    near = asked.join(samples, ["track_id", "bucket"]).where((F.col("s") >= F.col("t") - before) & (F.col("s") <= F.col("t") + after))
    best = near.groupBy("track_id", "t").agg(F.max_by("s", F.struct("v", -F.col("s"))).alias("peak"))
    return candidates.join(best, ["track_id", "t"], "left").withColumn("peak", F.coalesce("peak", "t"))


def decibels(rows: DataFrame, value: str, floor_db: float = 80.0) -> DataFrame:
    """Power in dB below the track's largest, floored, and scaled to [0, 1]."""
    top = F.max(F.greatest(F.col(value), F.lit(1e-10))).over(by_track())
    db = F.log10(F.greatest(F.col(value), F.lit(1e-10)) / top) * 10.0
    out = rows.withColumn("db", db).withColumn("db", F.greatest(F.col("db"), F.lit(-floor_db)))
    low, high = F.min("db").over(by_track()), F.max("db").over(by_track())
    return out.withColumn("scaled", (F.col("db") - low) / F.greatest(high - low, F.lit(1e-9)))
