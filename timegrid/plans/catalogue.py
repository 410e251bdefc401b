"""All queries of the timing operators, each with its SQL equivalent for DuckDB where SQL can express it.

Times of events are hours; snippets, tolerances and windows below are in hours too. Sums and means are rounded to six
decimals on both sides, because engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timegrid.functions import cols as C
from timegrid.operators import asof, bars, evaluate, grid, loops, period, prep, reports, series, stats
from timegrid.plans import sql as S
from timegrid.sources import scratch
from timegrid.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from timegrid.plans import formats, tracks  # noqa: F401  add their queries

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def _bars(spark, d) -> DataFrame:
    return bars.bars(T.downbeats(spark, d))


def _tempos(spark, d) -> DataFrame:
    return bars.tempos(_bars(spark, d))


def _order_tempos(spark, d) -> DataFrame:
    return bars.tempos(bars.tied_bars(T.order_days(spark, d)))


def _beats(spark, d) -> DataFrame:
    return asof.beats_to_bars(T.beats(spark, d), T.downbeats(spark, d))


def _ranges(spark, d) -> DataFrame:
    return grid.snippet_bars(_bars(spark, d), S.START, S.DURATION)


def _all_ranges(spark, d) -> DataFrame:
    return grid.snippet_bars(_bars(spark, d), S.ALL_START, S.ALL_DURATION)


def _ticks(spark, d, ranges=_ranges) -> DataFrame:
    return grid.onset_ticks(T.onsets(spark, d), grid.clipped(_bars(spark, d), ranges(spark, d)))


def _long(spark, d, patterns: DataFrame | None = None, methods: tuple[str, ...] | None = None) -> DataFrame:
    """The long grid over all hours."""
    onsets = scratch.written(T.onsets(spark, d).select("track_id", "t"), "onsets")
    return grid.grid_long(_bars(spark, d), onsets, S.ALL_START, S.ALL_DURATION, patterns=patterns, keep=scratch.written, methods=methods)


def _snippet_long(spark, d, method: str, ranges=_ranges) -> DataFrame:
    """The long grid of one of the methods without loops."""
    rows, ranges = _bars(spark, d), ranges(spark, d)
    inside = scratch.written(grid.clipped(rows, ranges), "inside")
    points, ticks = grid.complete_grid(inside).select("track_id", "bar", "tick", "grid_time"), grid.onset_ticks(T.onsets(spark, d), inside)
    if method == "uncorrected":
        return points.join(grid.uncorrected_phases(ticks), ["track_id", "bar", "tick"], "left").withColumn("method", F.lit(method))
    refs = scratch.written(grid.snippet_references(rows, ranges, T.onsets(spark, d)), "references")
    moved = points.join(refs.select("track_id", "ref_ms"), "track_id").select("track_id", "bar", "tick", (F.col("grid_time") + F.col("ref_ms") / 1000.0).alias("grid_time"))
    return moved.join(grid.snippet_phases(ticks, refs, False), ["track_id", "bar", "tick"], "left").withColumn("method", F.lit(method))


def _windows(spark, d) -> DataFrame:
    return loops.windows(_bars(spark, d), start=S.START, duration=S.DURATION)


# --- bars and tempo


@query(f'{S.BARS} SELECT track_id, bar, bstart AS start, bend AS "end" FROM bars')
def bars_from_boundaries(spark, d):
    return _bars(spark, d)


@query(f'{S.ORDER_BARS} SELECT track_id, bar, bstart AS start, bend AS "end", bend - bstart AS duration_s, tempo_bpm FROM obars')
def bar_tempo_eps(spark, d):
    return _order_tempos(spark, d)


@query(f'{S.ORDER_BARS} SELECT track_id, bar, bstart AS start, bend AS "end", bend - bstart AS duration_s, tempo_bpm FROM obars WHERE bend > bstart')
def bar_tempo_positive(spark, d):
    return bars.positive_tempos(bars.tied_bars(T.order_days(spark, d)))


@query(f'{S.ORDER_BARS} SELECT track_id, bar, bstart AS start, bend AS "end", CASE WHEN bend > bstart THEN round(60.0/(bend-bstart)*4, 2) END AS tempo_bpm FROM obars')
def bar_tempo_listed(spark, d):
    return bars.listed_tempos(bars.tied_bars(T.order_days(spark, d)))


@query(f"{S.BARS} SELECT track_id, count(*) AS n_bars, round(avg(tempo_bpm), 6) AS mean_bpm FROM bars GROUP BY track_id")
def global_tempo(spark, d):
    return rounded(bars.global_tempo(_tempos(spark, d)), "mean_bpm")


@query(f"""{S.BARS}, e AS (SELECT min(tempo_bpm) lo, max(tempo_bpm) hi FROM bars),
c AS (SELECT CAST(least(floor((tempo_bpm - lo) / ((hi - lo) / 20.0)), 19) AS INT) AS bin, count(*) AS n FROM bars, e GROUP BY 1)
SELECT bin, n, round(n * 100.0 / sum(n) OVER (), 6) AS percent FROM c""")
def tempo_histogram(spark, d):
    return rounded(bars.equal_width_histogram(_tempos(spark, d), "tempo_bpm"), "percent")


@query(f"{S.BEATS} SELECT track_id, beat_time, downbeat_time, beat_pos, global_beat, bar_num FROM btable")
def beats_to_bars(spark, d):
    return _beats(spark, d)


@query(f"{S.BEATS} SELECT DISTINCT track_id, downbeat_time AS t FROM btable WHERE bar_num >= 1 AND beat_pos = 1")
def strict_downbeats(spark, d):
    return bars.strict_downbeats(_beats(spark, d))


@query(f"{S.BEATS}, {S.signature('btable')} SELECT track_id, coalesce(n, 4) AS time_signature FROM (SELECT DISTINCT track_id FROM btable) LEFT JOIN best USING (track_id)")
def time_signature(spark, d):
    return bars.time_signature(_beats(spark, d))


@query(f"""{S.BEATS}, plain AS (SELECT track_id, beat_time, beat_pos, CAST(sum(CASE WHEN beat_pos = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY beat_time) AS INT) AS bar_num FROM btable), {S.signature('plain')}
SELECT track_id, coalesce(n, 4) AS time_signature FROM (SELECT DISTINCT track_id FROM btable) LEFT JOIN best USING (track_id)""")
def time_signature_resets(spark, d):
    return bars.time_signature(bars.bars_by_resets(_beats(spark, d).select("track_id", "beat_time", "beat_pos")))


@query(f"{S.CLASSES} SELECT track_id, bar, round(base, 6) AS base, round(over_, 6) AS override, class, dominant, orientation FROM classed")
def tempo_class(spark, d):
    return rounded(bars.track_classes(_tempos(spark, d)).select("track_id", "bar", "base", "override", "class", "dominant", "orientation"), "base", "override")


@query(f"""{S.REPAIRED} SELECT track_id, corrected_bar_num, array_to_string(src, '|') AS bar_num, round(bstart, 6) AS start, round(bend, 6) AS "end", action, round(removed, 6) AS removed, round(inserted, 6) AS inserted FROM fixed""")
def correct_bars(spark, d):
    fixed = bars.repaired(bars.track_classes(_tempos(spark, d)))
    out = fixed.select("track_id", "corrected_bar_num", F.array_join(F.transform("bar_num", lambda x: x.cast("string")), "|").alias("bar_num"), "start", "end", "action", "removed", "inserted")
    return rounded(out, "start", "end", "removed", "inserted")


@query(f"{S.REPAIRED}, {S.USABLE} SELECT track_id, corrected_bar_num, round(tempo_bpm, 6) AS tempo_bpm, usable, bpm_threshold FROM usable")
def usable_bars(spark, d):
    return rounded(bars.corrected_bars(_bars(spark, d)).select("track_id", "corrected_bar_num", "tempo_bpm", "usable", "bpm_threshold"), "tempo_bpm")


@query(f"""{S.REPAIRED}, {S.USABLE}, raw AS (SELECT track_id, count(*) AS raw_bars FROM bars GROUP BY 1)
SELECT track_id, raw_bars, count(*) AS corrected_bars, count(*) FILTER (usable) AS usable_bars, round(avg(tempo_bpm), 6) AS mean_corrected,
round(coalesce(avg(tempo_bpm) FILTER (usable), avg(tempo_bpm)), 6) AS mean_usable, any_value(dominant) AS dominant, any_value(orientation) AS orientation, round(any_value(ubase), 6) AS usable_base_bpm, any_value(bpm_threshold) AS bpm_threshold
FROM usable JOIN raw USING (track_id) GROUP BY track_id, raw_bars""")
def correction_stats(spark, d):
    rows = _bars(spark, d)
    return rounded(bars.correction_statistics(rows, bars.corrected_bars(rows)), "mean_corrected", "mean_usable", "usable_base_bpm")


@query(f"""{S.ORDERS}, s AS (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY tie) AS step FROM odays), v AS (SELECT track_id, count(*) AS n, min(step) AS least FROM s GROUP BY 1)
SELECT track_id, n >= 2 AND coalesce(least > 0, true) AS valid, CASE WHEN n < 2 THEN 'Not enough downbeats: ' || n || ' < 2' WHEN least <= 0 THEN 'Downbeats are not monotonically increasing' ELSE '' END AS message FROM v""")
def validate_boundaries(spark, d):
    return bars.validity(T.order_days(spark, d).withColumnRenamed("tie", "position"))


@query(f"""{S.ONSETS} SELECT track_id, event_id, abs(value - avg(value) OVER w) <= 2.0 * stddev_pop(value) OVER w AS kept FROM onsets WINDOW w AS (PARTITION BY track_id)""")
def outliers(spark, d):
    return bars.outliers(T.values(spark, d), "value").select("track_id", "event_id", "kept")


# --- as-of joins and the grid


@query(f"""{S.ONSETS}, tg AS (SELECT track_id, t AS g FROM onsets WHERE event_type = 'view'), pts AS (SELECT track_id, t FROM downs), {S.nearest('tg', 'pts', ['g'])}
SELECT track_id, g, nearest, distance FROM near_tg""")
def nearest_event(spark, d):
    targets = T.downbeats(spark, d, "view").withColumnRenamed("t", "g")
    return asof.nearest(targets, T.downbeats(spark, d))


@query(f"""{S.ONSETS}, tg AS (SELECT track_id, t AS g FROM onsets WHERE event_type = 'view'), pts AS (SELECT track_id, t FROM downs), {S.nearest('tg', 'pts', ['g'])}
SELECT track_id, g, nearest, distance FROM near_tg WHERE distance <= 12.0""")
def nearest_within(spark, d):
    targets = T.downbeats(spark, d, "view").withColumnRenamed("t", "g")
    return asof.nearest_within(targets, T.downbeats(spark, d), F.lit(12.0))


@query(f"{S.GRID} SELECT track_id, first_bar, last_bar FROM ranges")
def snippet_bars(spark, d):
    return _ranges(spark, d)


@query(f"{S.GRID} SELECT track_id, bar, tick, onset_time FROM ticks")
def onset_ticks(spark, d):
    return _ticks(spark, d).select("track_id", "bar", "tick", "onset_time")


@query(f"{S.GRID} SELECT track_id, bar, tick, onset_time, round((onset_time - bstart) / (bend - bstart) + 1.0/16, 6) AS phase FROM ticks")
def phase_uncorrected(spark, d):
    return rounded(grid.uncorrected_phases(_ticks(spark, d)), "phase")


@query(f"{S.GRID} SELECT track_id, bar, tick, grid_time FROM points")
def grid_times(spark, d):
    return grid.complete_grid(grid.clipped(_bars(spark, d), _ranges(spark, d))).select("track_id", "bar", "tick", "grid_time")


@query(f"{S.GRID} SELECT track_id, round(ref_ms, 6) AS ref_ms, ref_bar, round(ref_phase, 6) AS ref_phase, round(grid_phase, 6) AS grid_phase FROM refs")
def reference_offset(spark, d):
    return rounded(grid.snippet_references(_bars(spark, d), _ranges(spark, d), T.onsets(spark, d)), "ref_ms", "ref_phase", "grid_phase")


@query(f"{S.GRID} SELECT track_id, bar, tick, onset_time, phase FROM snippet_same UNION ALL SELECT track_id, bar, tick + 100, onset_time, phase FROM snippet_new")
def phase_per_snippet(spark, d):
    refs = grid.snippet_references(_bars(spark, d), _ranges(spark, d), T.onsets(spark, d))
    same, new = (grid.snippet_phases(_ticks(spark, d), refs, remap) for remap in (False, True))
    return rounded(same.unionByName(new.withColumn("tick", F.col("tick") + 100)), "phase")


def _loop_refs(spark, d, length):
    return grid.loop_references(grid.loops(_bars(spark, d), _ranges(spark, d), length), T.onsets(spark, d))


@query(f"{S.GRID}, {S.LOOPS} SELECT track_id, L, loop_bar, round(ref_ms, 6) AS ref_ms, ref_bar, round(ref_phase, 6) AS ref_phase, round(grid_phase, 6) AS grid_phase FROM lrefs WHERE L = 2")
def loop_reference(spark, d):
    return rounded(_loop_refs(spark, d, 2).select("track_id", "L", "loop_bar", "ref_ms", "ref_bar", "ref_phase", "grid_phase"), "ref_ms", "ref_phase", "grid_phase")


def _loop_query(length):
    def run(spark, d):
        return rounded(grid.loop_phases(_loop_refs(spark, d, length), T.onsets(spark, d)), "phase")

    run.__name__ = f"phase_loop_L{length}"
    return query(f"{S.GRID}, {S.LOOPS} SELECT track_id, L, bar, tick, onset_time, round(phase, 6) AS phase FROM lphases WHERE L = {length}")(run)


for _length in (1, 2, 4):
    _loop_query(_length)


@query(f"{S.ALL}, {S.LOOPS}, {S.LONG} SELECT track_id, method, L, bar, tick, onset_time, round(phase, 6) AS phase, round(grid_time, 6) AS grid_time FROM long")
def grid_long(spark, d):
    return rounded(_long(spark, d), "phase", "grid_time")


WIDE = ["uncorrected", "per_snippet", "standard_L2"]


@query(f"""{S.ALL}, {S.LOOPS}, {S.LONG} SELECT track_id, bar, tick, {', '.join(f"round(arg_min(phase, onset_time) FILTER (method = '{m}'), 6) AS {m}_phase, round(min(grid_time) FILTER (method = '{m}'), 6) AS {m}_grid_time" for m in WIDE)}
FROM long GROUP BY track_id, bar, tick""")
def grid_wide(spark, d):
    wide = grid.grid_wide(_long(spark, d, methods=WIDE), WIDE)
    return rounded(wide, *[c for c in wide.columns if c.endswith(("_phase", "_grid_time"))])


# --- summaries


@query(f"""{S.BARS}, placed AS (SELECT o.track_id, (o.t - b.bstart) / (b.bend - b.bstart) + 1.0/16 AS phase, b.bar, o.t FROM onsets o ASOF JOIN bars b ON o.track_id = b.track_id AND o.t >= b.bstart WHERE o.t < b.bend),
firsts AS (SELECT track_id, bar, CAST(least(greatest(round_even((phase - 1.0/16) * 16, 0), 0), 15) AS INT) AS tick, min(t) AS t, arg_min(phase, t) AS phase FROM placed GROUP BY 1, 2, 3)
SELECT track_id, count(*) AS n, round(sqrt(avg(power(phase - least(greatest(ceil(phase * 16 - 0.5), 0), 15) / 16.0, 2))), 6) AS rms_phase FROM firsts GROUP BY track_id""")
def rms_phase(spark, d):
    """The flagship: events to boundaries to bars, as-of assignment, ticks, phases, RMS per track."""
    ticks = grid.onset_ticks(T.onsets(spark, d), _bars(spark, d))
    return rounded(stats.phase_rms(grid.uncorrected_phases(ticks), ["track_id"]), "rms_phase")


#: Rows of the detected lengths: those of the standard grid of the same length.
PATTERNS = f"""{S.CRITERIA}, pat AS (SELECT track_id, 'bic' AS method, arg_min(L, (CASE WHEN sse > 0 THEN n * ln(sse / n) + (L - 1) * ln(n) ELSE '-inf'::DOUBLE END, L)) AS L FROM crit GROUP BY track_id
UNION ALL SELECT track_id, 'aicc', CAST(CASE WHEN count(*) FILTER (score IS NULL) > 0 THEN 4 ELSE min(L) FILTER (score = best OR score - best < 2) END AS INT) FROM (SELECT *, min(score) OVER (PARTITION BY track_id) AS best FROM (SELECT track_id, L, CASE WHEN n <= L + 1 THEN 'inf'::DOUBLE WHEN sse > 0 THEN n * ln(sse / n) + 2 * L + 2.0 * L * (L + 1) / (n - L - 1) END AS score FROM crit)) GROUP BY track_id)"""


def _patterns(spark, d) -> DataFrame:
    rows = _bars(spark, d)
    found = period.bic_period(period.bic(rows)).withColumn("method", F.lit("bic")).unionByName(period.aicc_period(period.aicc(rows)).withColumn("method", F.lit("aicc")))
    return scratch.written(found, "patterns")


@query(f"""{S.ALL}, {S.LOOPS}, {S.LONG}, {PATTERNS} SELECT l.track_id, pat.method, pat.L, bar, tick, onset_time, round(phase, 6) AS phase, round(grid_time, 6) AS grid_time FROM long l JOIN pat ON l.track_id = pat.track_id AND l.L = pat.L""")
def grid_patterns(spark, d):
    """The long grid of detected lengths, which differ by track."""
    return rounded(_long(spark, d, _patterns(spark, d), ("bic", "aicc")), "phase", "grid_time")


@query(f"""{S.ALL}, {S.LOOPS}, {S.LONG}, {PATTERNS}, {S.RMS} SELECT rms.track_id, pat.method, n, round(rms_phase, 6) AS rms_phase, round(rms_ms, 4) AS rms_ms FROM rms JOIN pat ON rms.track_id = pat.track_id AND rms.method = 'standard_L' || pat.L""")
def rms_patterns(spark, d):
    rows = stats.rms(_long(spark, d, _patterns(spark, d), ("bic", "aicc")))
    return rounded(rows, "rms_phase").withColumn("rms_ms", F.round("rms_ms", 4))


@query(f"{S.ALL}, {S.LOOPS}, {S.LONG}, {S.RMS} SELECT track_id, method, n, round(rms_phase, 6) AS rms_phase, round(rms_ms, 4) AS rms_ms FROM rms")
def rms_ms(spark, d):
    return rounded(stats.rms(_long(spark, d)), "rms_phase").withColumn("rms_ms", F.round("rms_ms", 4))


@query(f"""{S.ALL}, {S.LOOPS}, {S.LONG}, {S.RMS} SELECT track_id, {', '.join(f"round(max(rms_ms) FILTER (method = '{m}'), 4) AS {m}_ms" for m in WIDE)},
arg_min(method, list_position({WIDE!r}, method)) FILTER (rms_ms - least <= 1e-9) AS best FROM (SELECT *, min(rms_ms) OVER (PARTITION BY track_id) AS least FROM rms WHERE method IN ({', '.join(map(repr, WIDE))})) GROUP BY track_id""")
def rms_summary_best(spark, d):
    summary = stats.rms_summary(stats.rms(_long(spark, d, methods=WIDE)), WIDE)
    return summary.select("track_id", *(F.round(f"{m}_ms", 4).alias(f"{m}_ms") for m in WIDE), "best")


@query(f"""{S.ALL}, {S.LOOPS}, {S.LONG}, {S.RMS} SELECT track_id, {', '.join(f"round(coalesce(max(rms_ms) FILTER (method = '{m}'), 0), 4) AS {m}" for m in WIDE)} FROM rms GROUP BY track_id""")
def rms_comparison(spark, d):
    series_ = stats.comparison_series(stats.rms(_long(spark, d, methods=WIDE)), WIDE)
    return series_.select("track_id", *(F.round(m, 4).alias(m) for m in WIDE))


@query(f"""{S.ALL}, {S.LOOPS}, {S.LONG}, {S.RMS} SELECT track_id, method, round(CASE WHEN base = 0 THEN 0 ELSE (base - rms_ms) / base * 100 END, 3) + 0.0 AS gain FROM (SELECT *, max(rms_ms) FILTER (method = 'uncorrected') OVER (PARTITION BY track_id) AS base FROM rms)""")
def rms_improvement(spark, d):
    base = F.max(F.when(F.col("method") == "uncorrected", F.col("rms_ms"))).over(C.by_track())
    rows = stats.rms(_long(spark, d)).withColumn("base", base)
    return rows.select("track_id", "method", (F.round(C.improvement(F.col("base"), F.col("rms_ms")), 3) + 0.0).alias("gain"))


@query(f"""{S.ALL}, h AS (SELECT track_id, CAST((bar % 4) * 16 + tick + 1 AS INT) AS position, count(*) AS n FROM ticks GROUP BY 1, 2)
SELECT track_id, position, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT track_id FROM ticks), (SELECT CAST(unnest(range(1, 65)) AS INT) AS position)) LEFT JOIN h USING (track_id, position)""")
def rhythm_histogram(spark, d):
    return stats.rhythm_histogram(_ticks(spark, d, _all_ranges), 4)


@query(f"""{S.ALL}, h AS (SELECT CAST((bar % 4) * 16 + tick + 1 AS INT) AS position, count(*) AS n FROM ticks GROUP BY 1), f AS (SELECT position, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(1, 65)) AS INT) AS position) LEFT JOIN h USING (position))
SELECT position, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER () AS BIGINT) AS total, count(*) FILTER (n > 0) OVER () AS occupied, max(n) OVER () AS largest FROM f""")
def corpus_histogram(spark, d):
    return stats.corpus_histogram(stats.rhythm_histogram(_ticks(spark, d, _all_ranges), 4))


@query(f"{S.ALL}, {S.LOOPS}, {S.LONG}, {S.FOLD} SELECT track_id, loop, position, round(dev, 4) AS deviation_ms FROM fold")
def pattern_fold(spark, d):
    fold = stats.pattern_fold(_snippet_long(spark, d, "per_snippet", _all_ranges), 2)
    return fold.withColumn("deviation_ms", F.round("deviation_ms", 4) + 0.0)


@query(f"{S.ALL}, {S.LOOPS}, {S.LONG}, {S.FOLD} SELECT track_id, count(*) AS n, round(sqrt(avg(dev * dev)), 4) AS rms_ms FROM fold GROUP BY track_id")
def fold_rms(spark, d):
    return stats.fold_rms(stats.pattern_fold(_snippet_long(spark, d, "per_snippet", _all_ranges), 2)).withColumn("rms_ms", F.round("rms_ms", 4))


# --- periods


@query(f"{S.BARS}, {S.VECTORS} SELECT track_id, bar, array_to_string(list_transform(v, lambda x: CAST(x AS INT)), '') AS v FROM vectors")
def bar_vectors(spark, d):
    v = period.bar_vectors(T.onsets(spark, d), _bars(spark, d))
    return v.withColumn("v", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ""))


@query(f"{S.BARS}, {S.VECTORS}, {S.PROFILE} SELECT track_id, lag, value FROM profile")
def lag_profile(spark, d):
    pairs = period.lag_pairs(period.bar_vectors(T.onsets(spark, d), _bars(spark, d)))
    return period.lag_profile(pairs, C.circular_correlation(F.col("a"), F.col("b"), 4))


@query(f"""{S.BARS}, w AS (SELECT track_id, event_id, t - 12.0 AS w_start, t + 12.0 AS w_end FROM onsets WHERE event_type <> 'click')
SELECT track_id, event_id, bar FROM bars JOIN w USING (track_id) WHERE bstart < w_end AND bend > w_start""")
def overlap_many(spark, d):
    """Bars that overlap a day around each other event: many windows a track."""
    rows = T.table(spark, d, "events").where("event_type <> 'click'").select(F.col("user_id").alias("track_id"), "event_id", F.expr(T.HOURS).alias("t"))
    windows = rows.select("track_id", "event_id", (F.col("t") - 12.0).alias("w_start"), (F.col("t") + 12.0).alias("w_end"))
    return loops.overlapping(_bars(spark, d), windows, 24.0).select("track_id", "event_id", "bar")


@query(f"""{S.BARS}, e AS (SELECT min(tempo_bpm) lo, max(tempo_bpm) hi FROM bars), c AS (SELECT track_id, CAST(least(floor((tempo_bpm - lo) / ((hi - lo) / 20.0)), 19) AS INT) AS bin, count(*) AS n FROM bars, e GROUP BY 1, 2)
SELECT track_id, bin, n, round(n * 100.0 / sum(n) OVER (PARTITION BY track_id), 6) AS percent FROM c""")
def tempo_histogram_tracks(spark, d):
    """Histograms of all tracks over the same edges."""
    return rounded(bars.equal_width_histogram(_tempos(spark, d), "tempo_bpm", group=["track_id"]), "percent")


@query(f"{S.BARS}, {S.VECTORS}, {S.PROFILE.replace('median(', 'avg(')} SELECT track_id, lag, round(value, 6) AS value FROM profile")
def lag_profile_mean(spark, d):
    pairs = period.lag_pairs(period.bar_vectors(T.onsets(spark, d), _bars(spark, d)))
    return rounded(period.lag_profile(pairs, C.circular_correlation(F.col("a"), F.col("b"), 4), mean=True), "value")


@query(f"""{S.BARS}, ov AS (SELECT c_custkey AS track_id, c_acctbal / 20.0 AS offset_s FROM customer), w AS (SELECT track_id, coalesce(offset_s, 24.0) AS w_start, coalesce(offset_s, 24.0) + 200.0 AS w_end FROM (SELECT DISTINCT track_id FROM bars) LEFT JOIN ov USING (track_id))
SELECT track_id, count(*) AS n_bars, round(avg(tempo_bpm), 6) AS mean_bpm FROM bars JOIN w USING (track_id) WHERE bstart < w_end AND bend > w_start GROUP BY track_id""")
def overview_tempo(spark, d):
    """Tempos in windows that begin where an overview says, or by default, where it has no such track."""
    overview = T.table(spark, d, "customer").select(F.col("c_custkey").alias("track_id"), (F.col("c_acctbal").cast("double") / 20.0).alias("offset_s"))
    rows = _tempos(spark, d)
    return rounded(loops.snippet_tempo(rows, loops.windows(rows, overview, duration=200.0, default_start=24.0)), "mean_bpm")


@query(f"{S.BARS}, {S.VECTORS}, {S.PROFILE}, {S.POWER} SELECT track_id, L FROM power")
def period_onset(spark, d):
    return period.onset_period(T.onsets(spark, d), _bars(spark, d))


def _voiced(spark, d) -> DataFrame:
    return T.values(spark, d).withColumn("value", F.col("value") - 15.0)


VOICED = "vo AS (SELECT track_id, t, value - 15.0 AS value FROM onsets)"


@query(f"{S.BARS}, {VOICED}, {S.contour('vo', 'ct')} SELECT track_id, L FROM ct")
def period_contour(spark, d):
    return period.contour_period(_voiced(spark, d), _bars(spark, d))


@query(f"{S.BARS}, {S.CRITERIA} SELECT track_id, arg_min(L, (CASE WHEN sse > 0 THEN n * ln(sse / n) + (L - 1) * ln(n) ELSE '-inf'::DOUBLE END, L)) AS L FROM crit GROUP BY track_id")
def period_bic(spark, d):
    return period.bic_period(period.bic(_bars(spark, d)))


@query(f"""{S.BARS}, {S.CRITERIA}, s AS (SELECT track_id, L, CASE WHEN n <= L + 1 THEN 'inf'::DOUBLE WHEN sse > 0 THEN n * ln(sse / n) + 2 * L + 2.0 * L * (L + 1) / (n - L - 1) END AS score FROM crit),
m AS (SELECT *, min(score) OVER (PARTITION BY track_id) AS best FROM s)
SELECT track_id, CAST(CASE WHEN count(*) FILTER (score IS NULL) > 0 THEN 4 ELSE min(L) FILTER (score = best OR score - best < 2) END AS INT) AS L FROM m GROUP BY track_id""")
def period_aicc(spark, d):
    return period.aicc_period(period.aicc(_bars(spark, d)))


CHANNELS = ("click", "error", "purchase", "view")
#: Values of each kind of event in each bar, in order: as many frames as there are events, at 16 places.
FRAMES = f"""fr0 AS (SELECT o.track_id, b.bar, o.event_type AS channel, list(o.value ORDER BY o.t, o.event_id) AS f FROM onsets o ASOF JOIN bars b ON o.track_id = b.track_id AND o.t >= b.bstart WHERE o.t < b.bend GROUP BY 1, 2, 3),
fr1 AS (SELECT track_id, bar, channel, coalesce(f, [0.0::DOUBLE]) AS f FROM (SELECT track_id, bar, channel FROM bars, (SELECT unnest({list(CHANNELS)}) AS channel)) LEFT JOIN fr0 USING (track_id, bar, channel)),
fr2 AS (SELECT track_id, bar, channel, list_transform(range(16), lambda i: f[1 + CAST(floor(i * len(f) / 16.0::DOUBLE) AS INT)] + (f[least(2 + CAST(floor(i * len(f) / 16.0::DOUBLE) AS INT), len(f))] - f[1 + CAST(floor(i * len(f) / 16.0::DOUBLE) AS INT)]) * (i * len(f) / 16.0::DOUBLE - floor(i * len(f) / 16.0::DOUBLE))) AS v FROM fr1),
fr AS (SELECT track_id, bar, list(v ORDER BY channel) AS v FROM fr2 GROUP BY 1, 2)"""


def _frames(spark, d) -> DataFrame:
    """Frames of four channels, of unequal length by bar; a channel without events in a bar is one frame of 0."""
    rows = _bars(spark, d)
    events = T.table(spark, d, "events").select(F.col("user_id").alias("track_id"), "event_id", F.expr(T.HOURS).alias("t"), "value", F.col("event_type").alias("channel"))
    placed = asof.with_bars(events.where(F.col("channel").isin(*CHANNELS)), rows.select("track_id", "bar", "start", "end"))
    # a bar's own row stands for all channels
    channel = F.explode(F.when(F.col("channel").isNull(), F.array(*map(F.lit, CHANNELS))).otherwise(F.array("channel")))
    found = placed.select("track_id", "bar", "t", "event_id", "value", channel.alias("channel")).groupBy("track_id", "bar", "channel")
    f = F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "event_id", "value"))))
    return found.agg(f.alias("f")).select("track_id", "bar", "channel", F.when(F.size("f") == 0, F.array(F.lit(0.0))).otherwise(F.transform("f", lambda x: x["value"])).alias("frames"))


def _methods(spark, d) -> DataFrame:
    """Six methods: onsets, the contour of all values, bar lengths by two criteria, frames of four channels, and the contour of views alone."""
    pitch = T.table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("track_id"), F.expr(T.HOURS).alias("t"), "value")
    return period.all_methods(T.onsets(spark, d), _voiced(spark, d), _bars(spark, d), frames=_frames(spark, d), n_frames=16, pitch=pitch, keep=scratch.written)


METHODS = f"""{S.BARS}, {S.VECTORS}, {S.PROFILE}, {S.POWER}, {PATTERNS}, {VOICED}, {S.contour('vo', 'ct')}, vv AS (SELECT track_id, t, value FROM onsets WHERE event_type = 'view'), {S.contour('vv', 'pt')}, {FRAMES}, {S.channels('fr', 'ml', 16)},
found AS (SELECT track_id, 'onset' AS method, L FROM power UNION ALL SELECT track_id, 'contour', L FROM ct UNION ALL SELECT track_id, 'pitch', L FROM pt UNION ALL SELECT track_id, 'mel', L FROM ml UNION ALL SELECT track_id, method, L FROM pat),
lengths AS (SELECT track_id, method, CAST(coalesce(L, 4) AS INT) AS L FROM (SELECT DISTINCT track_id, unnest(['onset', 'contour', 'pitch', 'mel', 'bic', 'aicc']) AS method FROM bars) LEFT JOIN found USING (track_id, method))"""


@query(f"{METHODS} SELECT track_id, method, L FROM lengths")
def period_methods(spark, d):
    return _methods(spark, d)


@query(f"{METHODS}, c AS (SELECT track_id, L, count(*) AS c FROM lengths GROUP BY 1, 2) SELECT track_id, arg_max(L, (c, -L)) AS L FROM c GROUP BY track_id")
def period_consensus(spark, d):
    return period.consensus(_methods(spark, d))


EMBEDDED = "em AS (SELECT label AS track_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS bar, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), ec AS (SELECT track_id, bar, [v] AS v FROM em), e4 AS (SELECT track_id, bar, [v[1:16], v[17:32], v[33:48], v[49:64]] AS v FROM em)"


@query(f"WITH {EMBEDDED}, {S.channels('ec', 'ch', 64)} SELECT track_id, L FROM ch")
def period_channels(spark, d):
    return period.channel_period(T.frames(spark, d))


@query(f"WITH {EMBEDDED}, {S.channels('e4', 'ch', 16)} SELECT track_id, L FROM ch")
def period_multichannel(spark, d):
    parts = F.array(*(F.struct(F.lit(i).alias("channel"), F.slice("frames", 16 * i + 1, 16).alias("frames")) for i in range(4)))
    rows = T.frames(spark, d).select("track_id", "bar", F.explode(parts).alias("p")).select("track_id", "bar", "p.*")
    return period.multichannel_period(rows, 16)


@query(f"{S.BARS}, {FRAMES}, {S.channels('fr', 'ml', 16)} SELECT track_id, L FROM ml")
def period_ragged(spark, d):
    """Period of bars with unequal numbers of frames."""
    return period.multichannel_period(_frames(spark, d), 16)


@query(f"WITH {EMBEDDED}, {S.channels('ec', 'ch', 64)} SELECT track_id, lag, round(value, 6) AS value FROM ch_p")
def channel_profile(spark, d):
    return rounded(period.channel_profile(T.frames(spark, d)), "value")


# --- snippets, loops, exports


@query(f"{S.BARS} SELECT track_id, count(*) AS n_bars, round(avg(tempo_bpm), 6) AS mean_bpm FROM bars WHERE bstart < {S.START + S.DURATION} AND bend > {S.START} GROUP BY track_id")
def snippet_tempo(spark, d):
    return rounded(loops.snippet_tempo(_tempos(spark, d), _windows(spark, d)), "mean_bpm")


@query(f"""{S.BARS} SELECT track_id, CAST(bar // 4 AS INT) AS loop, min(bstart) AS start, max(bend) AS "end", count(*) AS n_bars, round(avg(tempo_bpm), 6) AS mean_bpm FROM bars GROUP BY 1, 2""")
def loop_tempos(spark, d):
    return rounded(loops.loop_tempos(_tempos(spark, d), 4), "mean_bpm")


@query(f"""{S.BARS}, g AS (SELECT track_id, count(*) AS n_bars, avg(tempo_bpm) AS global_bpm FROM bars GROUP BY 1), s AS (SELECT track_id, count(*) AS snippet_bars, avg(tempo_bpm) AS snippet_bpm FROM bars WHERE bstart < {S.START + S.DURATION} AND bend > {S.START} GROUP BY 1),
l AS (SELECT track_id, count(*) AS n_loops, avg(m) AS loop_bpm FROM (SELECT track_id, bar // 4 AS k, avg(tempo_bpm) AS m FROM bars GROUP BY 1, 2) GROUP BY 1)
SELECT track_id, n_bars, round(global_bpm, 6) AS global_bpm, coalesce(snippet_bars, 0) AS snippet_bars, round(snippet_bpm, 6) AS snippet_bpm, n_loops, round(loop_bpm, 6) AS loop_bpm FROM g LEFT JOIN s USING (track_id) LEFT JOIN l USING (track_id)""")
def track_summary(spark, d):
    return rounded(loops.track_summary(_tempos(spark, d), _windows(spark, d), 4), "global_bpm", "snippet_bpm", "loop_bpm")


@query(f"{S.BARS} SELECT track_id, round(coalesce(avg(tempo_bpm) FILTER (bar < 4), 120.0), 6) AS export_bpm FROM bars GROUP BY track_id")
def export_tempo(spark, d):
    return rounded(loops.export_tempo(_tempos(spark, d), 4), "export_bpm")


@query(f"""{S.BARS}, i AS (SELECT track_id, min(bar) - 0.5 AS lo, max(bar) + 0.5 AS hi FROM bars WHERE bstart >= {S.START} AND bstart < {S.START + S.DURATION} GROUP BY 1)
SELECT track_id, CAST(lo AS DOUBLE) AS "left", CAST(hi AS DOUBLE) AS "right" FROM (SELECT DISTINCT track_id FROM bars) LEFT JOIN i USING (track_id)""")
def window_in_bars(spark, d):
    out = loops.window_in_bars(_bars(spark, d), _windows(spark, d))
    return out.select("track_id", F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right"))


@query(f"""{S.BARS}, {S.CRITERIA}, p AS (SELECT track_id, arg_min(L, (CASE WHEN sse > 0 THEN n * ln(sse / n) + (L - 1) * ln(n) ELSE '-inf'::DOUBLE END, L)) AS L FROM crit GROUP BY track_id),
f AS (SELECT track_id, min(bstart) AS first_start, max(bend) AS last_end, count(*) AS n_bars FROM bars WHERE bstart >= {S.START} AND bend <= {S.START + S.DURATION} GROUP BY 1)
SELECT track_id, first_start, last_end, n_bars, round(last_end - first_start, 6) AS duration, CAST(n_bars // L AS INT) AS bic_loops FROM f LEFT JOIN p USING (track_id)""")
def snippet_info(spark, d):
    patterns = period.bic_period(period.bic(_bars(spark, d))).withColumn("method", F.lit("bic"))
    info = loops.snippet_info(_bars(spark, d), _windows(spark, d), patterns)
    return rounded(info.withColumn("bic_loops", F.try_element_at("complete_loops", F.lit("bic"))).drop("complete_loops"), "duration")


@query(f"""{S.BARS}, b AS (SELECT track_id, bar, bstart, (bend - bstart) * 1000 AS len FROM bars WHERE bar < (SELECT max(x.bar) FROM bars x WHERE x.track_id = bars.track_id) UNION ALL SELECT track_id, bar, bstart, NULL FROM bars WHERE bar = (SELECT max(x.bar) FROM bars x WHERE x.track_id = bars.track_id))
SELECT track_id, bar, round((bstart - min(bstart) OVER w) * 1000, 4) AS begin_ms, round(coalesce(len, median(len) OVER w), 4) AS duration_ms FROM b WINDOW w AS (PARTITION BY track_id)""")
def bar_durations(spark, d):
    out = loops.bar_durations(_bars(spark, d).select("track_id", "bar", "start"))
    return out.withColumn("begin_ms", F.round("begin_ms", 4)).withColumn("duration_ms", F.round("duration_ms", 4))


@query(f"""{S.GRID}, b AS (SELECT track_id, bar, min(grid_time) AS s FROM points GROUP BY 1, 2), f AS (SELECT track_id, min(onset_time) * 1000 AS o FROM ticks GROUP BY 1), l AS (SELECT track_id, bar, s, (lead(s) OVER (PARTITION BY track_id ORDER BY bar) - s) * 1000 AS len FROM b)
SELECT bar AS bar_number, CAST(track_id AS VARCHAR) AS song_id, CAST(track_id AS VARCHAR) AS song_info, round(o, 3) AS first_onset_ms, round((s - min(s) OVER w) * 1000, 3) AS begin_ms, round(coalesce(len, median(len) OVER w), 3) AS duration_ms FROM l LEFT JOIN f USING (track_id) WINDOW w AS (PARTITION BY track_id)""")
def bar_duration_export(spark, d):
    out = loops.duration_export(_snippet_long(spark, d, "uncorrected"))
    return out.withColumns({c: F.round(c, 3) for c in ("first_onset_ms", "begin_ms", "duration_ms")})


@query(f"""{S.ALL}, {S.LOOPS}, {S.LONG}, b AS (SELECT *, bar - min(bar) OVER (PARTITION BY track_id, method) AS b FROM long)
SELECT * FROM (SELECT track_id, method, round(min(grid_time) FILTER (b = 0), 6) AS loop_start, round(min(grid_time) FILTER (b = 4), 6) AS loop_end FROM b WHERE tick = 0 GROUP BY 1, 2) WHERE loop_start IS NOT NULL AND loop_end IS NOT NULL""")
def loop_bounds(spark, d):
    return rounded(loops.loop_bounds(_long(spark, d), 4), "loop_start", "loop_end")


@query(f"""{S.GRID}, b AS (SELECT *, bar - min(bar) OVER (PARTITION BY track_id) AS b FROM points), e AS (SELECT track_id, min(grid_time) FILTER (b = 0) AS s, min(grid_time) FILTER (b = 4) AS f FROM b WHERE tick = 0 GROUP BY 1)
SELECT track_id, event_id, t, round(t - s, 6) AS "offset" FROM onsets JOIN e USING (track_id) WHERE t >= s AND t < f""")
def events_in_loops(spark, d):
    points = grid.complete_grid(grid.clipped(_bars(spark, d), _ranges(spark, d))).withColumn("method", F.lit("uncorrected"))
    out = loops.events_in_loops(T.onsets(spark, d), loops.loop_bounds(points, 4))
    return rounded(out.select("track_id", "event_id", "t", "offset"), "offset")


@query(f"""{S.BARS} SELECT o.track_id, o.event_id, o.t, b.bar FROM onsets o JOIN bars b ON o.track_id = b.track_id AND o.t >= b.bstart AND o.t < b.bend WHERE b.bstart >= {S.START} AND b.bend <= {S.START + S.DURATION}""")
def events_in_full_bars(spark, d):
    return loops.events_in_full_bars(T.onsets(spark, d), _bars(spark, d), S.START, S.START + S.DURATION)


@query(f"""{S.GRID}, n AS (SELECT track_id, bar, tick, grid_time, row_number() OVER (PARTITION BY track_id ORDER BY bar, tick) AS k FROM points WHERE grid_time IS NOT NULL) SELECT track_id, bar, tick, grid_time FROM n WHERE k <= 32""")
def first_ticks(spark, d):
    points = grid.complete_grid(grid.clipped(_bars(spark, d), _ranges(spark, d))).withColumn("method", F.lit("uncorrected"))
    return loops.first_ticks(points, 2).select("track_id", "bar", "tick", "grid_time")


@query(f"""{S.REPAIRED}, {S.USABLE}, u AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY bstart) AS bar_num, bstart, tempo_bpm FROM bars), c AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY bstart) AS bar_num, bstart, tempo_bpm, usable FROM usable)
SELECT coalesce(u.track_id, c.track_id) AS track_id, coalesce(u.bar_num, c.bar_num) AS bar_num, u.bstart AS downbeat_raw, round(u.tempo_bpm, 6) AS tempo_raw, round(c.bstart, 6) AS downbeat_corrected, round(c.tempo_bpm, 6) AS tempo_corrected, coalesce(usable, false) AS usable FROM u FULL JOIN c ON u.track_id = c.track_id AND u.bar_num = c.bar_num""")
def bar_tempo_pairs(spark, d):
    rows = _bars(spark, d)
    return rounded(loops.paired_tempos(bars.tempos(rows), bars.corrected_bars(rows)), "tempo_raw", "downbeat_corrected", "tempo_corrected")


@query(f"""{S.ONSETS}, a AS (SELECT track_id, event_id, t, CAST(floor((t - min(t) OVER (PARTITION BY track_id)) * 480) AS BIGINT) AS tick FROM onsets),
b AS (SELECT *, row_number() OVER w AS n, greatest(0, tick - coalesce(lag(tick + 120) OVER w, 0)) AS on_ FROM a WINDOW w AS (PARTITION BY track_id ORDER BY t, event_id))
SELECT track_id, n, 'on' AS kind, on_ AS delta FROM b UNION ALL SELECT track_id, n, 'off', 120 FROM b""")
def delta_ticks(spark, d):
    return loops.delta_ticks(T.onsets(spark, d), 480.0, 120)


def _roles(spark, d) -> DataFrame:
    return T.table(spark, d, "conversations").select(F.col("conv_id").alias("track_id"), F.col("turn").cast("double").alias("t"), F.col("role").alias("note")).distinct()


RUNS = """WITH c AS (SELECT DISTINCT conv_id AS track_id, CAST(turn AS DOUBLE) AS t, role AS note FROM conversations), g AS (SELECT *, CASE WHEN note IS NOT DISTINCT FROM lag(note) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY track_id ORDER BY t, note)),
h AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY t, note ROWS UNBOUNDED PRECEDING) AS run FROM g), s AS (SELECT track_id, run, note, min(t) AS start, max(t) AS last, count(*) AS n FROM h GROUP BY 1, 2, 3),
runs AS (SELECT track_id, CAST(run AS BIGINT) AS run, note, start, n, coalesce(lead(start) OVER (PARTITION BY track_id ORDER BY run), last) AS stop FROM s)"""


@query(f'{RUNS} SELECT track_id, run, note, start, n, stop AS "end" FROM runs')
def value_runs(spark, d):
    return series.runs(_roles(spark, d), order=("t", "note")).withColumn("run", F.col("run").cast("long"))


@query(f"""{RUNS}, a AS (SELECT *, CAST(floor((start - min(start) OVER (PARTITION BY track_id)) * 24) AS BIGINT) AS a, CAST(floor((stop - min(start) OVER (PARTITION BY track_id)) * 24) AS BIGINT) AS b FROM runs),
m AS (SELECT *, row_number() OVER w AS k, greatest(0, a - coalesce(lag(b) OVER w, 0)) AS on_ FROM a WINDOW w AS (PARTITION BY track_id ORDER BY start, note))
SELECT track_id, k AS n, note, 'on' AS kind, on_ AS delta FROM m UNION ALL SELECT track_id, k, note, 'off', b - a FROM m""")
def interval_ticks(spark, d):
    return loops.interval_ticks(series.runs(_roles(spark, d), order=("t", "note")).drop("n"), 24.0)


# --- series


@query(f"""{S.ONSETS}, g AS (SELECT track_id, t, t - lag(t) OVER (PARTITION BY track_id ORDER BY t) AS gap FROM downs), w AS (SELECT *, CAST(round_even(gap / 24.0, 0) - 1 AS INT) AS n FROM g WHERE gap > 48.0)
SELECT track_id, round(t, 6) AS t, false AS added FROM g UNION ALL SELECT track_id, round(t - gap + i * 24.0, 6), true FROM (SELECT track_id, t, gap, unnest(range(1, n + 1)) AS i FROM w WHERE n >= 1)""")
def gap_fill(spark, d):
    return rounded(series.gap_fill(T.downbeats(spark, d), 24.0), "t")


@query(f"""WITH RECURSIVE onsets AS MATERIALIZED ({S.ONSET_SELECT}), k AS (SELECT track_id, min(t) AS t FROM onsets GROUP BY 1 UNION ALL SELECT k.track_id, (SELECT min(o.t) FROM onsets o WHERE o.track_id = k.track_id AND o.t - k.t >= 6.0) FROM k WHERE k.t IS NOT NULL)
SELECT track_id, t FROM k WHERE t IS NOT NULL""")
def min_spacing(spark, d):
    return series.min_spacing(T.onsets(spark, d), 6.0)


PEAKS = f"""{S.ONSETS}, v AS (SELECT track_id, event_id, t, value / max(abs(value)) OVER (PARTITION BY track_id) AS value FROM onsets), p AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM v WINDOW w AS (PARTITION BY track_id ORDER BY t)),
peaks AS (SELECT track_id, event_id, t, value FROM p WHERE value > a AND value > b AND value >= 0.3)"""


@query(f"{PEAKS} SELECT track_id, event_id, t, round(value, 6) AS value FROM peaks")
def peak_pick(spark, d):
    return rounded(series.peaks(series.peak_normalised(T.values(spark, d)), 0.3), "value")


@query(f"{S.ONSETS} SELECT track_id, t, coalesce((SELECT arg_max(o.t, (abs(o.value), -o.t)) FROM onsets o WHERE o.track_id = d.track_id AND o.t >= d.t - 4.0 AND o.t <= d.t + 10.0), t) AS peak FROM downs d")
def peak_refine(spark, d):
    return series.refined_peaks(T.downbeats(spark, d), T.values(spark, d), 4.0, 10.0)


@query(f"""{S.ONSETS}, m AS (SELECT track_id, event_id, greatest(-80.0, 10 * log10(greatest(value, 1e-10) / max(greatest(value, 1e-10)) OVER (PARTITION BY track_id))) AS db FROM onsets)
SELECT track_id, event_id, round(db, 6) AS db, round((db - min(db) OVER w) / greatest(max(db) OVER w - min(db) OVER w, 1e-9), 6) AS scaled FROM m WINDOW w AS (PARTITION BY track_id)""")
def decibels(spark, d):
    return rounded(series.decibels(T.values(spark, d), "value").select("track_id", "event_id", "db", "scaled"), "db", "scaled")


@query(f"""{S.ONSETS} SELECT event_id, CASE WHEN value > 0 THEN CAST(least(greatest(round_even(log2(value * 10 / 440.0) * 12.0 + 69.0, 0), 0), 127) AS INT) END AS note, round(t - floor(t), 6) AS unit, CASE WHEN value <> 0 THEN round(t / value, 6) ELSE 0 END AS ratio,
CAST(least(greatest(round_even((t - floor(t)) * 16, 0), 0), 15) AS INT) AS tick, round(1.0 / (1.0 + exp(-value)), 6) AS activation FROM onsets""")
def scalar_functions(spark, d):
    unit = C.unit_phase(F.col("t"))
    rows = T.values(spark, d)
    return rows.select("event_id", C.note_of(F.col("value") * 10).alias("note"), r6(unit).alias("unit"), r6(C.safe_divide(F.col("t"), F.col("value"))).alias("ratio"), C.nearest_tick(unit).alias("tick"), r6(C.sigmoid(F.col("value"))).alias("activation"))


@query("""SELECT event_id, CASE WHEN e > 1e-6 THEN round(60.0 / e * 4, 6) ELSE 0 END AS tempo, CAST(least(greatest(round_even(e * 16, 0), 0), 15) AS INT) AS tick, CASE WHEN value > 0 THEN CAST(least(greatest(round_even(log2(value / 440.0) * 12.0 + 69, 0), 0), 127) AS INT) END AS note FROM (SELECT event_id, value, value / 100.0 AS e FROM events)""")
def sql_functions(spark, d):
    C.register(spark)
    return T.table(spark, d, "events").selectExpr("event_id", "round(bar_tempo(value / 100D, 4), 6) AS tempo", "nearest_tick(value / 100D, 16) AS tick", "note_of(value) AS note")


# --- lookups and reports


@query(f"""{S.ONSETS}, t AS (SELECT DISTINCT track_id FROM onsets) SELECT track_id, coalesce(s, -1) AS supplier FROM t LEFT JOIN (SELECT s_suppkey AS track_id, s_nationkey AS s FROM supplier) USING (track_id)""")
def lookup_default(spark, d):
    tracks = T.onsets(spark, d).select("track_id").distinct()
    table = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("track_id"), F.col("s_nationkey").alias("supplier"))
    return reports.lookup_with_default(tracks, table, "track_id", "supplier", -1)


@query("""WITH n AS (SELECT DISTINCT unnest([CAST(o_custkey AS VARCHAR), CAST(o_custkey AS VARCHAR) || '_take', upper(o_orderpriority), CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority || ' - live', '-' || CAST(o_custkey AS VARCHAR)]) AS name FROM orders),
k AS (SELECT name, split_part(name, '_', 1) AS prefix, trim(regexp_replace(split_part(lower(name), ' - ', 1), '^[0-9]+[_ ]+', '')) AS part FROM n),
o AS (SELECT CAST(c_custkey AS VARCHAR) AS id, min(c_custkey / 10.0) AS off FROM customer GROUP BY 1), p AS (SELECT lower(o_orderpriority) AS nm, min(o_custkey) + 0.5 AS off FROM orders GROUP BY 1)
SELECT name, CAST(coalesce(a.off, b.off, c.off, d.off, 0.0) AS DOUBLE) AS "offset" FROM k LEFT JOIN o a ON a.id = name LEFT JOIN o b ON b.id = prefix AND regexp_full_match(prefix, '[0-9]+') LEFT JOIN p c ON c.nm = lower(name) LEFT JOIN p d ON d.nm = part""")
def lookup_priority(spark, d):
    """Names from the whole keys of all orders, looked up in all customers; those with a leading '-' have no match."""
    customer, priority = F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    orders = T.table(spark, d, "orders")
    names = F.array(customer, F.concat(customer, F.lit("_take")), F.upper(priority), F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), priority, F.lit(" - live")), F.concat(F.lit("-"), customer))
    by_id = T.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("song_id"), F.lit(None).cast("string").alias("songname"), (F.col("c_custkey") / 10.0).alias("offset"))
    by_name = orders.groupBy(F.lower(priority).alias("songname")).agg((F.min("o_custkey") + 0.5).cast("double").alias("offset")).select(F.lit(None).cast("string").alias("song_id"), "songname", "offset")
    return reports.lookup_by_priority(orders.select(F.explode(names).alias("name")).distinct(), by_id.unionByName(by_name))


_queries["lookup_priority_all"], _sql["lookup_priority_all"] = lookup_priority, _sql["lookup_priority"]


@query("""WITH r AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) SELECT user_id AS track_id, count(*) AS events, CAST(sum(k) AS BIGINT) AS total, count(*) FILTER (k % 2 = 0) AS even, count(*) FILTER (k IS NULL) AS missing FROM r GROUP BY user_id""")
def json_summary(spark, d):
    rows = T.table(spark, d, "events").select(F.col("user_id").alias("track_id"), F.from_json("props", "k INT")["k"].alias("k"))
    return rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("events"), F.sum("k").alias("total"), F.count_if(F.col("k") % 2 == 0).alias("even"), F.count_if(F.col("k").isNull()).alias("missing"))


@query(f"""{S.BARS}, {S.CRITERIA}, p AS (SELECT track_id, arg_min(L, (CASE WHEN sse > 0 THEN n * ln(sse / n) + (L - 1) * ln(n) ELSE '-inf'::DOUBLE END, L)) AS L FROM crit GROUP BY track_id), c AS (SELECT 'bic' AS method, L, count(*) AS tracks FROM p GROUP BY L)
SELECT method, L, tracks, round(tracks * 100.0 / sum(tracks) OVER (), 6) AS percent FROM c""")
def pattern_distribution(spark, d):
    patterns = period.bic_period(period.bic(_bars(spark, d))).withColumn("method", F.lit("bic"))
    return rounded(stats.length_distribution(patterns), "percent")


@query(f"""{S.BARS}, l AS (SELECT track_id, count(*) AS n FROM bars GROUP BY 1), m AS (SELECT 'bars' AS method, CAST(n AS DOUBLE) AS v FROM l UNION ALL SELECT 'loops_L' || x, CAST(n // x AS DOUBLE) FROM l, (SELECT unnest([1, 2, 4]) AS x))
SELECT method, count(v) AS n, round(avg(v), 6) AS mean, median(v) AS median, min(v) AS least, max(v) AS largest FROM m GROUP BY method""")
def loop_statistics(spark, d):
    n = _bars(spark, d).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array(F.struct(F.lit("bars").alias("method"), F.col("n").cast("double").alias("v")), *(F.struct(F.lit(f"loops_L{x}").alias("method"), F.floor(F.col("n") / x).cast("double").alias("v")) for x in (1, 2, 4)))
    rows = n.select(F.explode(parts).alias("p")).select("p.*")
    return rounded(stats.spread(rows, ["method"], "v"), "mean")


@query(f"{S.ONSETS} SELECT DISTINCT track_id FROM onsets WHERE track_id NOT IN (SELECT track_id FROM downs WHERE t < 48)")
def not_yet_processed(spark, d):
    return reports.not_done(T.onsets(spark, d).select("track_id").distinct(), T.downbeats(spark, d).where("t < 48"))


@query(r"SELECT page_id, CAST(regexp_extract(url, '/(\d+)(?:[?#].*)?$', 1) AS INT) AS id FROM pages WHERE TRY_CAST(regexp_extract(url, '/(\d+)(?:[?#].*)?$', 1) AS INT) BETWEEN 100 AND 800")
def url_id_range(spark, d):
    rows = T.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)(?:[?#].*)?$", 1).alias("name"))
    return rows.where(C.in_id_range(F.col("name"), 100, 800)).select("page_id", F.col("name").cast("int").alias("id"))


@query(f"""{S.ONSETS}, t AS (SELECT track_id, count(*) FILTER (event_type = 'click') AS c, count(*) AS n FROM onsets GROUP BY 1), e AS (SELECT *, c >= 2 AND n >= 60 AS ok FROM t) SELECT count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed FROM e""")
def outcome_counts(spark, d):
    rows = T.table(spark, d, "events").groupBy(F.col("user_id").alias("track_id")).agg(F.count_if(F.col("event_type") == "click").alias("c"), F.count(F.lit(1)).alias("n"))
    report = reports.validation_report(rows, {"downbeats": F.col("c") >= 2, "onsets": F.col("n") >= 60})
    return reports.outcome_counts(report.withColumn("ok", F.size("errors") == 0))


@query("SELECT p_name, CASE WHEN instr(p_name, '_') > 0 THEN split_part(p_name, '_', 1) ELSE p_name END AS song_id, CASE WHEN instr(p_name, '_') > 0 THEN substr(p_name, instr(p_name, '_') + 1) ELSE p_name END AS song_info FROM (SELECT replace(p_name, ' ', '_') AS p_name FROM part)")
def song_names(spark, d):
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    return T.table(spark, d, "part").select(name.alias("p_name"), C.song_id(name).alias("song_id"), C.song_info(name).alias("song_info"))


# --- training data and evaluation


def _items(spark, d) -> DataFrame:
    return T.table(spark, d, "documents").select(F.col("source").alias("dataset"), F.col("doc_id").alias("item"))


@query()
def fold_split(spark, d):
    return prep.folds(_items(spark, d))


@query()
def fold_roles(spark, d):
    return prep.roles(prep.folds(_items(spark, d), everywhere=("src1",)))


LABELS = f"""{S.ONSETS}, n AS (SELECT track_id, CAST(round_even(t * 10, 0) AS BIGINT) AS f FROM downs), l AS (SELECT track_id, f + d AS frame, max(w) AS label FROM n, (VALUES (0, 1.0), (1, 0.5), (-1, 0.5), (2, 0.25), (-2, 0.25)) x(d, w) WHERE f + d >= 0 GROUP BY 1, 2)"""


@query(f"{LABELS} SELECT track_id, frame, CAST(label AS DOUBLE) AS label FROM l")
def frame_labels(spark, d):
    return prep.frame_labels(T.downbeats(spark, d), 10.0)


@query(f"{LABELS} SELECT track_id, frame / 10.0 AS t FROM l WHERE label > 0.5")
def label_events(spark, d):
    return prep.label_events(prep.frame_labels(T.downbeats(spark, d), 10.0), 10.0)


@query("""WITH n AS (SELECT doc_id AS track_id, n_chars AS n FROM documents WHERE n_chars > 0), c AS (SELECT track_id, n, unnest(CASE WHEN n <= 512 THEN [0] WHEN n % 512 = 0 THEN list_transform(range(0, n // 512), lambda i: i * 512) ELSE list_append(list_transform(range(0, n // 512), lambda i: i * 512), n - 512) END) AS start FROM n)
SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY start) - 1 AS INT) AS chunk, CAST(start AS BIGINT) AS start, CAST(least(start + 512, n) AS BIGINT) AS "end" FROM c""")
def chunks(spark, d):
    return prep.chunks(T.table(spark, d, "documents").select(F.col("doc_id").alias("track_id"), F.col("n_chars").alias("n")), 512)


@query(f"""{S.BARS}, g AS (SELECT track_id, avg(tempo_bpm) AS bpm FROM bars GROUP BY 1), b AS (SELECT track_id, CAST(round_even(round(bpm, 6), 0) AS INT) AS b FROM g), l AS (SELECT track_id, b + d AS bin, w FROM b, (VALUES (0, 1.0), (1, 0.5), (-1, 0.5), (2, 0.25), (-2, 0.25)) x(d, w) WHERE b >= 0 AND b < 300 AND b + d BETWEEN 0 AND 299)
SELECT track_id, bin, round(w / sum(w) OVER (PARTITION BY track_id), 6) AS label FROM l""")
def tempo_label(spark, d):
    means = rounded(bars.global_tempo(_tempos(spark, d)), "mean_bpm").select("track_id", F.col("mean_bpm").alias("bpm"))
    return rounded(prep.tempo_labels(means), "label")


@query()
def stem_mix(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    padded = F.concat(x, F.array_repeat(F.lit(0.0), F.pmod(-F.size(x), F.lit(5))))  # five channels of equal length
    width = (F.size("x") / 5).cast("int")
    rows = T.table(spark, d, "embeddings").select("vec_id", padded.alias("x")).select("vec_id", *(F.slice("x", F.lit(1) + i * width, width).alias(f"c{i}") for i in range(5)))
    mixed = prep.mixed_channels(rows, "vec_id", [f"c{i}" for i in range(5)])
    return mixed.select("vec_id", F.size("mix").alias("channels"), r6(F.aggregate(F.flatten("mix"), F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(f"""{S.BARS}, n AS (SELECT track_id, CAST(round_even((t - lag(t) OVER (PARTITION BY track_id ORDER BY t)) * 1.0, 0) AS BIGINT) AS d FROM downs), c AS (SELECT track_id, d, count(*) AS c FROM n WHERE d >= 1 GROUP BY 1, 2),
s AS (SELECT track_id, d + k AS bin, sum(c * w) AS s FROM c, (VALUES (-2, 1.0), (-1, 2.0), (0, 3.0), (1, 2.0), (2, 1.0)) x(k, w) GROUP BY 1, 2), p AS (SELECT track_id, arg_max(bin, (s, -bin)) AS peak FROM s GROUP BY 1),
q AS (SELECT p.track_id, peak, coalesce(max(s) FILTER (bin = peak - 1), 0) AS a, coalesce(max(s) FILTER (bin = peak), 0) AS b, coalesce(max(s) FILTER (bin = peak + 1), 0) AS c FROM p JOIN s USING (track_id) GROUP BY 1, 2),
z AS (SELECT track_id, peak + CASE WHEN a - 2 * b + c <> 0 THEN 0.5 * (a - c) / (a - 2 * b + c) ELSE 0 END AS place FROM q)
SELECT track_id, round(CASE WHEN place > 0 THEN 60.0 / place ELSE -1 END, 6) AS bpm FROM (SELECT DISTINCT track_id FROM downs) LEFT JOIN z USING (track_id)""")
def interval_tempo(spark, d):
    return rounded(prep.interval_tempo(T.downbeats(spark, d), fps=1.0), "bpm")


#: Pairs by a scan of both sides' sorted lists, one step at a time.
MATCHED = f"""{S.ONSETS.replace('WITH ', 'WITH RECURSIVE ', 1)}, tr AS (SELECT DISTINCT track_id, t FROM onsets WHERE event_type = 'view'), li AS MATERIALIZED (SELECT track_id, a, b FROM (SELECT track_id, list(t ORDER BY t) AS a FROM downs GROUP BY 1) JOIN (SELECT track_id, list(t ORDER BY t) AS b FROM tr GROUP BY 1) USING (track_id)),
sc AS (SELECT track_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(0 AS BIGINT) AS tp FROM li UNION ALL SELECT track_id, i + (abs(a[i] - b[j]) <= 12.0 OR a[i] < b[j])::INT, j + (abs(a[i] - b[j]) <= 12.0 OR a[i] > b[j])::INT, tp + (abs(a[i] - b[j]) <= 12.0)::INT FROM sc JOIN li USING (track_id) WHERE i <= len(a) AND j <= len(b)),
k AS (SELECT track_id, max(tp) AS tp FROM sc GROUP BY 1), a AS (SELECT track_id, count(*) AS n_true FROM tr GROUP BY 1), b AS (SELECT track_id, count(*) AS n_predicted FROM downs GROUP BY 1)"""


@query(f"""{MATCHED} SELECT track_id, n_true, coalesce(n_predicted, 0) AS n_predicted, coalesce(tp, 0) AS tp, round(2.0 * coalesce(tp, 0) / (n_true + coalesce(n_predicted, 0)), 6) AS f FROM a LEFT JOIN b USING (track_id) LEFT JOIN k USING (track_id) WHERE n_true >= 2""")
def beat_fmeasure(spark, d):
    return rounded(evaluate.f_measure(T.downbeats(spark, d), T.downbeats(spark, d, "view"), 12.0), "f")


@query(f"""{S.ONSETS}, tr AS (SELECT DISTINCT track_id, t FROM onsets WHERE event_type = 'view'), v0 AS (SELECT *, row_number() OVER w - 1 AS k, lead(t) OVER w - t AS d FROM tr WINDOW w AS (PARTITION BY track_id ORDER BY t)),
v1 AS (SELECT track_id, unnest([{{'v': 'same', 't': t}}, {{'v': 'off', 't': t + d * 0.5}}, {{'v': 'double', 't': t}}, {{'v': 'double', 't': t + d * 0.5}}, {{'v': 'triple', 't': t}}, {{'v': 'triple', 't': t + d / 3.0}}, {{'v': 'triple', 't': t + d * 2.0 / 3.0}}, {{'v': '2' || (k % 2), 't': t}}, {{'v': '3' || (k % 3), 't': t}}]) AS x FROM v0),
av AS (SELECT track_id || '/' || x.v AS key, track_id, x.v AS v, x.t AS t FROM v1 WHERE x.t IS NOT NULL), an AS (SELECT *, coalesce(t - lag(t) OVER w, lead(t) OVER w - t) AS step, count(*) OVER (PARTITION BY key) AS n FROM av WINDOW w AS (PARTITION BY key ORDER BY t)),
pn AS (SELECT *, row_number() OVER w AS j, coalesce(t - lag(t) OVER w, lead(t) OVER w - t) AS step, count(*) OVER (PARTITION BY track_id) AS n FROM downs WINDOW w AS (PARTITION BY track_id ORDER BY t)),
pv AS (SELECT DISTINCT key, av.track_id, v, j, pn.t AS t, step, n FROM av JOIN pn USING (track_id)),
nr AS (SELECT p.*, CASE WHEN y.t IS NULL OR p.t - x.t < y.t - p.t THEN x.t ELSE y.t END AS near FROM pv p ASOF LEFT JOIN an x ON p.key = x.key AND p.t >= x.t ASOF LEFT JOIN an y ON p.key = y.key AND p.t <= y.t),
ok AS (SELECT nr.key, j, j - row_number() OVER (PARTITION BY nr.key ORDER BY j) AS run FROM nr JOIN an ON nr.key = an.key AND nr.near = an.t WHERE abs(nr.t - near) <= an.step * 0.4 AND abs(1 - nr.step / an.step) <= 0.4),
ru AS (SELECT key, max(c) AS longest, sum(c) AS total FROM (SELECT key, run, count(*) AS c FROM ok GROUP BY 1, 2) GROUP BY 1), na AS (SELECT key, track_id, v, any_value(n) AS n FROM an GROUP BY 1, 2, 3), np AS (SELECT track_id, any_value(n) AS m FROM pn GROUP BY 1),
sc AS (SELECT track_id, v, CASE WHEN n > 1 AND coalesce(m, 0) > 1 THEN coalesce(longest, 0) / greatest(n, m) ELSE 0 END AS c, CASE WHEN n > 1 AND coalesce(m, 0) > 1 THEN coalesce(total, 0) / greatest(n, m) ELSE 0 END AS t FROM na LEFT JOIN np USING (track_id) LEFT JOIN ru USING (key)),
f AS (SELECT track_id, max(c) FILTER (v = 'same') AS c1, max(t) FILTER (v = 'same') AS t1, max(c) AS c2, max(t) AS t2 FROM sc GROUP BY 1)
SELECT track_id, round(c1, 6) AS cmlc, round(t1, 6) AS cmlt, round(CASE WHEN c1 > 0.5 THEN c1 ELSE c2 END, 6) AS amlc, round(CASE WHEN c1 > 0.5 THEN t1 ELSE t2 END, 6) AS amlt FROM f""")
def beat_continuity(spark, d):
    predicted, truth = T.downbeats(spark, d), T.downbeats(spark, d, "view")
    return rounded(evaluate.levels(predicted, truth, 0.4), "cmlc", "cmlt", "amlc", "amlt")


@query(f"""{MATCHED}, f AS (SELECT track_id % 5 AS dataset, CASE WHEN track_id % 2 = 0 THEN 'downbeat' ELSE 'beat' END AS kind, n_true AS n, 2.0 * coalesce(tp, 0) / (n_true + coalesce(n_predicted, 0)) AS value FROM a LEFT JOIN b USING (track_id) LEFT JOIN k USING (track_id) WHERE n_true >= 2)
SELECT dataset, kind, round(sum(value * n) / sum(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS weight FROM f WHERE kind = 'beat' OR dataset <> 3 GROUP BY dataset, kind""")
def score_means(spark, d):
    """Means by data set and kind of beat; data set 3 has no downbeats."""
    scores = evaluate.f_measure(T.downbeats(spark, d), T.downbeats(spark, d, "view"), 12.0)
    kind = F.when(F.col("track_id") % 2 == 0, "downbeat").otherwise("beat")
    rows = scores.select((F.col("track_id") % 5).alias("dataset"), kind.alias("kind"), F.col("n_true").alias("n"), F.col("f").alias("value"))
    return rounded(stats.weighted_means(stats.with_downbeats(rows, without=(3,)), ["dataset", "kind"]), "mean")


@query("""WITH r AS (SELECT user_id AS track_id, value - 15 AS logit, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 WHEN 'purchase' THEN -1.0 ELSE 0.0 END AS truth FROM events)
SELECT track_id, round(sum(CASE WHEN truth <> -1 AND (1.0 / (1.0 + exp(-logit)) >= 0.5) = (truth > 0.6) THEN 1.0 ELSE 0.0 END) / (sum(CASE WHEN truth <> -1 THEN 1.0 ELSE 0.0 END) + 1e-4), 6) AS accuracy FROM r GROUP BY 1""")
def binary_accuracy(spark, d):
    kind = F.col("event_type")
    truth = F.when(kind == "click", 1.0).when(kind == "view", 0.5).when(kind == "purchase", -1.0).otherwise(0.0)
    rows = T.table(spark, d, "events").select(F.col("user_id").alias("track_id"), (F.col("value") - 15).alias("logit"), truth.alias("truth"))
    return rounded(evaluate.binary_accuracy(rows, ["track_id"]), "accuracy")


@query(f"{S.BARS} SELECT track_id, bar FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM bars) WHERE n >= 12")
def corpus_filter(spark, d):
    return stats.corpus_filter(_bars(spark, d)).select("track_id", "bar")
