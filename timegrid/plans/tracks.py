"""Queries of long tracks, which several tasks share, and of tracks in different metres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.operators import asof, bars, grid, ranges, series, stats
from timegrid.plans import sql as S
from timegrid.plans.catalogue import query, rounded
from timegrid.sources import scratch
from timegrid.sources import tables as T

#: Rows of a long track that a task takes in these queries.
ROWS = 1 << 12


def _one(df: DataFrame) -> DataFrame:
    """All users' events as one track."""
    return df.withColumn("track_id", F.lit(0).cast("long"))


def _sides(spark, d) -> tuple[DataFrame, DataFrame, ranges.Cuts]:
    onsets, downs = _one(T.onsets(spark, d)), _one(T.downbeats(spark, d)).distinct()
    return onsets, downs, ranges.cuts([(onsets, "t")], ROWS)


def one(sql: str) -> str:
    return sql.replace("user_id AS track_id", "CAST(0 AS BIGINT) AS track_id")


@query(f'{one(S.BARS)} SELECT o.track_id, o.event_id, b.bar, b.bstart AS start, b.bend AS "end" FROM onsets o ASOF JOIN bars b ON o.track_id = b.track_id AND o.t >= b.bstart WHERE o.t < b.bend')
def one_track_bars(spark, d):
    """All events in the bars of all clicks: one track, in ranges of time."""
    onsets, downs, cuts = _sides(spark, d)
    return asof.in_bars(onsets, bars.bars(downs, cuts), cuts=cuts).select("track_id", "event_id", "bar", "start", "end")


@query(f"""{one(S.ONSETS)}, tg AS (SELECT DISTINCT track_id, t AS g FROM onsets WHERE event_type = 'view'), pts AS (SELECT track_id, t FROM downs), {S.nearest('tg', 'pts', ['g'])}
SELECT track_id, g, nearest, distance FROM near_tg""")
def one_track_nearest(spark, d):
    _, downs, cuts = _sides(spark, d)
    targets = _one(T.downbeats(spark, d, "view")).distinct().withColumnRenamed("t", "g")
    return asof.nearest(targets, downs, cuts=cuts)


@query(f"{one(S.BEATS)} SELECT track_id, beat_time, downbeat_time, beat_pos, global_beat, bar_num FROM btable")
def one_track_beats(spark, d):
    _, downs, cuts = _sides(spark, d)
    return asof.beats_to_bars(_one(T.beats(spark, d)).distinct(), downs, cuts=cuts)


@query(f"""WITH RECURSIVE onsets AS MATERIALIZED ({one(S.ONSET_SELECT)}), k AS (SELECT track_id, min(t) AS t FROM onsets GROUP BY 1 UNION ALL SELECT k.track_id, (SELECT min(o.t) FROM onsets o WHERE o.t - k.t >= 0.5) FROM k WHERE k.t IS NOT NULL)
SELECT track_id, t FROM k WHERE t IS NOT NULL""")
def one_track_spacing(spark, d):
    onsets, _, cuts = _sides(spark, d)
    return series.min_spacing_in_ranges(onsets, 0.5, cuts)


@query(f"""{S.BARS}, d AS (SELECT track_id, bend - bstart AS d FROM bars) SELECT CAST(-1 AS BIGINT) AS track_id, count(*) AS n, round(median(d), 9) AS duration FROM d UNION ALL SELECT track_id, count(*), round(median(d), 9) FROM d GROUP BY track_id""")
def median_durations(spark, d):
    """Median duration of the bars of all tracks together (-1), and of each."""
    rows = bars.bars(T.downbeats(spark, d)).select("track_id", (F.col("end") - F.col("start")).alias("duration"))
    whole = stats.exact_percentile(rows, [], "duration").select(F.lit(-1).cast("long").alias("track_id"), "n", "duration")
    return whole.unionByName(stats.exact_percentile(rows, ["track_id"], "duration")).withColumn("duration", F.round("duration", 9))


# --- metres by track: 3 beats where the most frequent number of beats in a bar is odd, else 4

METRES = f"WITH metre AS (SELECT track_id, CASE WHEN n % 2 = 1 THEN 12 ELSE 16 END AS steps FROM ({S.BEATS}, {S.signature('btable')} SELECT track_id, coalesce(n, 4) AS n FROM (SELECT DISTINCT track_id FROM btable) LEFT JOIN best USING (track_id)))"


def by_metre(select: str, *parts: str) -> str:
    """SQL of the grid for each metre, of the tracks that are in it."""
    own = (f"SELECT * FROM ({S.in_steps(', '.join(parts), n)} {select} WHERE track_id IN (SELECT track_id FROM metre WHERE steps = {n}) OR ({n} = 16 AND track_id NOT IN (SELECT track_id FROM metre)))" for n in (12, 16))
    return f"{METRES} {' UNION ALL '.join(own)}"


def _mixed(spark, d) -> DataFrame:
    signatures = bars.time_signature(asof.beats_to_bars(T.beats(spark, d), T.downbeats(spark, d)))
    metres = signatures.withColumn("time_signature", F.when(F.col("time_signature") % 2 == 1, 3).otherwise(4))
    rows = grid.with_steps(bars.bars(T.downbeats(spark, d)), metres)
    onsets = scratch.written(T.onsets(spark, d).select("track_id", "t"), "onsets")
    return grid.grid_long(rows, onsets, S.ALL_START, S.ALL_DURATION, steps="steps", keep=scratch.written)


@query(by_metre("SELECT track_id, method, L, bar, tick, onset_time, round(phase, 6) AS phase, round(grid_time, 6) AS grid_time FROM long", S.ALL, S.LOOPS, S.LONG))
def grid_mixed_metre(spark, d):
    """The long grid of tracks in 3/4 and 4/4, each in the steps of its own metre."""
    return rounded(_mixed(spark, d).drop("steps"), "phase", "grid_time")


@query(by_metre("SELECT track_id, method, n, round(rms_phase, 6) AS rms_phase, round(rms_ms, 4) AS rms_ms FROM rms", S.ALL, S.LOOPS, S.LONG, S.RMS))
def rms_mixed_metre(spark, d):
    return rounded(stats.rms(_mixed(spark, d), "steps"), "rms_phase").withColumn("rms_ms", F.round("rms_ms", 4))
