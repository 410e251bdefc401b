"""As-of and nearest joins of keyed points, without range joins.

Both sides are united and sorted once per track; a running last (or following first) value carries the match. So a
join shuffles each side once by track and is linear in its rows; windows spill, nothing is collected.

`cuts`, of ranges.cuts over both sides, spreads long tracks over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timegrid.operators.ranges import RANGE, Cuts


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema.fields if f.name in columns)


def _united(points: DataFrame, bounds: DataFrame, time: str, bound_time: str, key: str, cuts: Cuts | None = None) -> tuple[DataFrame, list[str], list[str]]:
    own, other = [c for c in points.columns if c != key], [c for c in bounds.columns if c != key]
    left = bounds.select(key, F.col(bound_time).alias("_t"), F.lit(0).alias("_kind"), F.struct(*other).alias("_bound"), F.lit(None).cast(f"struct<{_schema(points, own)}>").alias("_point"))
    right = points.select(key, F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(f"struct<{_schema(bounds, other)}>").alias("_bound"), F.struct(*own).alias("_point"))
    both = left.unionByName(right)
    return (cuts.placed(both, "_t") if cuts else both), own, other


def last_before(points: DataFrame, bounds: DataFrame, time: str = "t", bound_time: str = "t", key: str = "track_id", cuts: Cuts | None = None) -> DataFrame:
    """Each point with `bound`, the last bound at or before it (null: none)."""
    both, own, _ = _united(points, bounds, time, bound_time, key, cuts)
    if cuts:
        found = cuts.last(both, "_bound", ["_t", "_kind"], "_bound")
    else:
        running = Window.partitionBy(key).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_bound", F.last("_bound", ignorenulls=True).over(running))
    return found.where("_kind = 1").select(key, *(F.col(f"_point.{c}").alias(c) for c in own), F.col("_bound").alias("bound"))


def in_bars(points: DataFrame, bars: DataFrame, time: str = "t", key: str = "track_id", cuts: Cuts | None = None) -> DataFrame:
    """Each point inside a half-open bar [start, end), with the bar's columns; bars don't overlap."""
    own = [c for c in points.columns if c != key]
    matched = last_before(points, bars, time, "start", key, cuts).where(F.col(time) < F.col("bound.end"))
    return matched.select(key, *own, *(F.col(f"bound.{c}").alias(c) for c in bars.columns if c != key))


def with_bars(points: DataFrame, bars: DataFrame, time: str = "t", key: str = "track_id") -> DataFrame:
    """As in_bars, and a row for each bar with nulls in place of a point, so that bars without points stay."""
    both, own, other = _united(points, bars, time, "start", key)
    running = Window.partitionBy(key).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_bound", F.last("_bound", ignorenulls=True).over(running)).where((F.col("_kind") == 0) | (F.col("_t") < F.col("_bound.end")))
    return found.select(key, *(F.col(f"_point.{c}").alias(c) for c in own), *(F.col(f"_bound.{c}").alias(c) for c in other))


def nearest(targets: DataFrame, points: DataFrame, target: str = "g", time: str = "t", key: str = "track_id", cuts: Cuts | None = None, later: bool = False) -> DataFrame:
    """Each target with `nearest` and `distance` of the nearest point; the earlier (or later) of two; null if there is none."""
    spots = points.select(key, F.col(time).alias("_spot"))
    both, own, _ = _united(targets, spots, target, "_spot", key, cuts)
    sides = ["_t", "_kind"]
    if cuts:
        both = cuts.first(cuts.last(both, "_bound", sides, "_last"), "_bound", sides, "_next")
    else:
        # looked back on from either end: a frame up to the end of a window is worked out anew for each row
        for name, order in (("_last", sides), ("_next", [F.desc(c) for c in sides])):
            both = both.withColumn(name, F.last("_bound", ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = both.where("_kind = 1").select(key, *(F.col(f"_point.{c}").alias(c) for c in own), F.col("_last._spot").alias("_before"), F.col("_next._spot").alias("_after"))
    g = F.col(target)
    first, second = g - F.col("_before"), F.col("_after") - g
    pick = F.when(F.col("_after").isNull() | (first < second if later else first <= second), F.col("_before")).otherwise(F.col("_after"))
    return rows.withColumn("nearest", pick).withColumn("distance", F.abs(F.col("nearest") - g)).drop("_before", "_after")


def nearest_within(targets: DataFrame, points: DataFrame, limit, **names) -> DataFrame:
    """As nearest, for targets whose nearest point is no farther than `limit` (a Column or number)."""
    return nearest(targets, points, **names).where(F.col("distance") <= limit)


def _beats_in_ranges(beats: DataFrame, bounds: DataFrame, key: str, cuts: Cuts) -> DataFrame:
    """The beat table by numbers: of beats, of downbeats, and of the last beat before each downbeat."""
    counted = cuts.numbered(cuts.placed(beats.select(key, "t"), "t"), ["t"], "global_beat").drop(RANGE)
    bars = cuts.numbered(cuts.placed(bounds, "t"), ["t"], "bar_num").drop(RANGE)
    # a beat at the downbeat's time belongs to its bar: only beats before count
    both, _, _ = _united(bars, counted, "t", "t", key, cuts)
    found = cuts.last(both.withColumn("_kind", 1 - F.col("_kind")), "_bound", ["_t", "_kind"], "_bound")
    bars = found.where("_kind = 0").select(key, F.col("_point.t").alias("t"), F.col("_point.bar_num").alias("bar_num"), F.coalesce("_bound.global_beat", F.lit(0)).alias("beats_before"))
    rows = last_before(counted, bars, key=key, cuts=cuts)
    pos = F.coalesce(F.col("global_beat") - F.col("bound.beats_before"), F.lit(0))
    return rows.select(key, F.col("t").alias("beat_time"), F.coalesce("bound.t", F.lit(0.0)).alias("downbeat_time"), pos.cast("int").alias("beat_pos"), F.col("global_beat").cast("int").alias("global_beat"), F.coalesce("bound.bar_num", F.lit(0)).cast("int").alias("bar_num"))


def beats_to_bars(beats: DataFrame, downbeats: DataFrame, key: str = "track_id", cuts: Cuts | None = None) -> DataFrame:
    """The beat table: bar_num and beat_pos of each beat; both 0, and downbeat 0.0, before the first downbeat."""
    bounds = downbeats.select(key, "t").distinct()
    if cuts:
        return _beats_in_ranges(beats, bounds, key, cuts)
    both = bounds.select(key, "t", F.lit(0).alias("kind")).unionByName(beats.select(key, "t", F.lit(1).alias("kind")))
    run = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("bar_num", F.sum(1 - F.col("kind")).over(run).cast("int")).withColumn("downbeat_time", F.last(F.when(F.col("kind") == 0, F.col("t")), ignorenulls=True).over(run)).withColumn("global_beat", F.sum("kind").over(run).cast("int"))
    first = Window.partitionBy(key, "bar_num").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.when(F.col("bar_num") == 0, 0).otherwise(F.sum("kind").over(first)).cast("int")
    rows = both.withColumn("beat_pos", pos).where("kind = 1")
    return rows.select(key, F.col("t").alias("beat_time"), F.coalesce("downbeat_time", F.lit(0.0)).alias("downbeat_time"), "beat_pos", "global_beat", "bar_num")
