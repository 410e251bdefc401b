"""The metric grid: ticks, phases and grid times, uncorrected and under reference offsets, in long form.

Bars are rows (track_id, bar, start, end); onsets are rows (track_id, t, ...). Methods are rows too, not columns.

`steps`, the steps of a bar, is a number for all tracks or the name of a column of the bars that says it for each track
(`with_steps` derives that from time signatures). It then goes along through ticks, loops, phases and grids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timegrid.functions import cols as C
from timegrid.operators import asof

STEPS = C.STEPS
SUBDIVISIONS = 4
#: Ticks that are tried as references, in this order, whatever the metre.
PRIORITY = (0, 8, 4, 12)
Steps = int | str
LONG = ["track_id", "method", "L", "bar", "tick", "onset_time", "phase", "grid_time"]


def _n(steps: Steps) -> Column:
    return F.col(steps) if isinstance(steps, str) else F.lit(steps)


def _along(steps: Steps) -> list[str]:
    """The columns that a table has to keep for its steps."""
    return [steps] if isinstance(steps, str) else []


def _by_key(df: DataFrame) -> DataFrame:
    """df for joins by key with both sides in order: a table with rows for each track isn't sent to all, as the size of its compressed file tells nothing of its rows."""
    return df.hint("merge")


def with_steps(bars: DataFrame, signatures: DataFrame, name: str = "steps", default: int = 4) -> DataFrame:
    """bars with the steps of their track: SUBDIVISIONS for each beat of its signature (track_id, time_signature)."""
    found = signatures.select("track_id", F.col("time_signature").alias("_beats"))
    rows = bars.join(_by_key(found), "track_id", "left")
    return rows.withColumn(name, (F.coalesce("_beats", F.lit(default)) * SUBDIVISIONS).cast("int")).drop("_beats")


def snippet_bars(bars: DataFrame, start: float, duration: float) -> DataFrame:
    """Per track the first bar that starts at or after `start` (else 0) and the last before its end (else the last)."""
    return bars.groupBy("track_id").agg(
        F.coalesce(F.min(F.when(F.col("start") >= start, F.col("bar"))), F.lit(0)).alias("first_bar"),
        F.coalesce(F.max(F.when(F.col("start") < start + duration, F.col("bar"))), F.max("bar")).alias("last_bar"),
    )


def clipped(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """The bars of each track's range, by a join on the track before anything is exploded."""
    return bars.join(_by_key(ranges), "track_id").where("bar BETWEEN first_bar AND last_bar")


def onset_ticks(onsets: DataFrame, bars: DataFrame, steps: Steps = STEPS) -> DataFrame:
    """The first onset of each bar and tick: track_id, bar, start, end, tick, onset_time."""
    own = ["bar", "start", "end", *_along(steps)]
    placed = asof.in_bars(onsets.select("track_id", "t"), bars.select("track_id", *own))
    tick = C.nearest_tick(C.phase(F.col("t"), F.col("start"), F.col("end") - F.col("start")), _n(steps))
    return placed.withColumn("tick", tick).groupBy("track_id", *own, "tick").agg(F.min("t").alias("onset_time"))


def uncorrected_phases(ticks: DataFrame, steps: Steps = STEPS) -> DataFrame:
    p = C.phase(F.col("onset_time"), F.col("start"), F.col("end") - F.col("start"))
    return ticks.select("track_id", "bar", "tick", "onset_time", C.shifted(p, _n(steps)).alias("phase"), *_along(steps))


def snippet_phases(ticks: DataFrame, references: DataFrame, remap: bool, steps: Steps = STEPS) -> DataFrame:
    """Phases against a grid that is shifted by the track's reference (ref_ms); remap: ticks are assigned anew."""
    p = C.phase(F.col("onset_time"), F.col("start"), F.col("end") - F.col("start"), F.col("ref_ms") / 1000.0)
    joined = ticks.join(references.select("track_id", "ref_ms"), "track_id").withColumn("_p", p)
    tick = C.nearest_tick(F.col("_p"), _n(steps)) if remap else F.col("tick")
    return joined.select("track_id", "bar", tick.alias("tick"), "onset_time", C.shifted(F.col("_p"), _n(steps)).alias("phase"), *_along(steps))


def _first_match(candidates: DataFrame, onsets: DataFrame, keys: list[str], share: float) -> DataFrame:
    """For each key, as `ref`, the candidate of the lowest (rank, bar) whose nearest onset is within share of a step; else null."""
    near = asof.nearest(candidates, onsets)
    ref = F.struct(
        ((F.col("nearest") - F.col("g")) * 1000.0).alias("ref_ms"), F.col("bar").alias("ref_bar"),
        ((F.col("nearest") - F.col("bar_start")) / F.col("bar_length")).alias("ref_phase"), ((F.col("g") - F.col("bar_start")) / F.col("bar_length")).alias("grid_phase"),
    )
    close = F.when(F.col("distance") <= F.col("step") * share, F.struct("rank", "bar"))
    return near.groupBy(*keys).agg(F.min_by(ref, close).alias("ref"))


def _candidates() -> Column:
    return F.posexplode(F.array(*map(F.lit, PRIORITY))).alias("rank", "tick")


def snippet_references(bars: DataFrame, ranges: DataFrame, onsets: DataFrame, num_bars: int = 1, share: float = 0.5, steps: Steps = STEPS) -> DataFrame:
    """One reference per track, from the first bars of its range: the ticks of PRIORITY in their order; else none, 0."""
    first = bars.join(_by_key(ranges), "track_id").where((F.col("bar") >= F.col("first_bar")) & (F.col("bar") < F.col("first_bar") + num_bars) & (F.col("end") > F.col("start")))
    step = (F.col("end") - F.col("start")) / _n(steps).cast("double")
    candidates = first.select("track_id", "bar", F.col("start").alias("bar_start"), (F.col("end") - F.col("start")).alias("bar_length"), step.alias("step"), _candidates())
    candidates = candidates.withColumn("g", F.col("bar_start") + F.col("tick") * F.col("step")).drop("tick")
    found = _first_match(candidates, onsets, ["track_id"], share)
    zero = F.lit(0.0)
    return ranges.join(_by_key(found), "track_id", "left").select(
        "track_id", F.coalesce("ref.ref_ms", zero).alias("ref_ms"), F.coalesce("ref.ref_bar", "first_bar").alias("ref_bar"),
        F.coalesce("ref.ref_phase", zero).alias("ref_phase"), F.coalesce("ref.grid_phase", zero).alias("grid_phase"),
    )


LOOP = ["loop_bar", "last_bar", "loop_start", "loop_end"]


def _looped(starts: DataFrame, bars: DataFrame, keys: list[str], steps: Steps) -> DataFrame:
    """Loops from rows of their first bars, with the end of their last; one without an end is dropped."""
    ends = bars.select(*keys, (F.col("bar") + 1 - F.col("L")).alias("bar"), F.col("end").alias("loop_end"))
    return starts.join(_by_key(ends), [*keys, "bar"]).select(*keys, F.col("bar").alias("loop_bar"), "last_bar", F.col("start").alias("loop_start"), "loop_end", *_along(steps))


def loops(bars: DataFrame, ranges: DataFrame, length: int | Column, steps: Steps = STEPS) -> DataFrame:
    """Loops of `length` bars from each range's first bar on; one that the track's boundaries don't complete is dropped.

    length: a number, a column, or an explode of several numbers.
    """
    rows = bars.join(_by_key(ranges), "track_id").withColumn("L", C.lit(length))
    return _looped(rows.where("bar BETWEEN first_bar AND last_bar AND (bar - first_bar) % L = 0"), rows, ["track_id", "L"], steps)


def loop_bars(loop_rows: DataFrame, steps: Steps = STEPS) -> DataFrame:
    """The equally long bars of each loop, as far as the range goes."""
    n = _n(steps)
    sixteenth = (F.col("loop_end") - F.col("loop_start")) / (F.col("L") * n)
    rows = loop_rows.withColumn("step", sixteenth).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("L").cast("int") - 1)))
    rows = rows.withColumn("bar", F.col("loop_bar") + F.col("offset")).where("bar <= last_bar")
    start = F.col("loop_start") + (F.col("offset") * n) * F.col("step")
    return rows.withColumn("bar_start", start).withColumn("bar_length", n.cast("double") * F.col("step"))


def loop_references(loop_rows: DataFrame, onsets: DataFrame, share: float = 0.5, steps: Steps = STEPS) -> DataFrame:
    """One reference per loop, on its equidistant grid over all its bars; none: 0 at the loop's first bar."""
    keys = ["track_id", "L", *LOOP, *_along(steps)]
    whole = loop_bars(loop_rows.withColumn("_last", F.col("last_bar")).withColumn("last_bar", F.col("loop_bar") + F.col("L") - 1), steps).withColumn("last_bar", F.col("_last"))
    candidates = whole.select(*keys, "bar", "bar_start", "bar_length", "step", "offset", _candidates())
    candidates = candidates.withColumn("g", F.col("loop_start") + (F.col("offset") * _n(steps) + F.col("tick")) * F.col("step")).drop("tick", "offset")
    found = _first_match(candidates, onsets, keys, share)  # every loop has candidates
    zero = F.lit(0.0)
    return found.select(
        *keys, F.coalesce("ref.ref_ms", zero).alias("ref_ms"), F.coalesce("ref.ref_bar", "loop_bar").alias("ref_bar"),
        F.coalesce("ref.ref_phase", zero).alias("ref_phase"), F.coalesce("ref.grid_phase", zero).alias("grid_phase"),
    )


def _loop_onsets(references: DataFrame, onsets: DataFrame, steps: Steps) -> DataFrame:
    """All onsets (t) in the loops' equidistant bars, and a row without t for each of these bars."""
    own = ["bar", "loop_start", "offset", "step", "bar_length", "ref_ms", *_along(steps)]
    rows = loop_bars(references, steps).withColumn("key", F.struct("track_id", "L"))
    spans = rows.select("key", F.col("bar_start").alias("start"), (F.col("bar_start") + F.col("bar_length")).alias("end"), *own)
    lengths = references.select("track_id", "L").distinct()
    points = onsets.select("track_id", "t").join(_by_key(lengths), "track_id").select(F.struct("track_id", "L").alias("key"), "t")
    return asof.with_bars(points, spans, key="key").select(F.col("key.track_id").alias("track_id"), F.col("key.L").alias("L"), "t", "start", *own)


def loop_phases(references: DataFrame, onsets: DataFrame, steps: Steps = STEPS) -> DataFrame:
    """Phases of all onsets in the loops' equidistant bars, less the loop's reference; several may share a tick."""
    placed = _loop_onsets(references, onsets, steps).where("t IS NOT NULL")
    p = C.phase(F.col("t"), F.col("start"), F.col("bar_length"), F.col("ref_ms") / 1000.0)
    placed = placed.withColumn("_p", p)
    return placed.select("track_id", "L", "bar", C.nearest_tick(F.col("_p"), _n(steps)).alias("tick"), F.col("t").alias("onset_time"), C.shifted(F.col("_p"), _n(steps)).alias("phase"))


def loop_grid_times(references: DataFrame, steps: Steps = STEPS) -> DataFrame:
    rows = loop_bars(references, steps).withColumn("tick", F.explode(F.sequence(F.lit(0), _n(steps) - 1)))
    g = F.col("loop_start") + (F.col("offset") * _n(steps) + F.col("tick")) * F.col("step") + F.col("ref_ms") / 1000.0
    return rows.select("track_id", "L", "bar", "tick", g.alias("grid_time"))


def complete_grid(bars: DataFrame, steps: Steps = STEPS) -> DataFrame:
    """All bars times all ticks, with the bar's uncorrected grid time; bars without length have none."""
    rows = bars.withColumn("tick", F.explode(F.sequence(F.lit(0), _n(steps) - 1)))
    duration = F.col("end") - F.col("start")
    return rows.withColumn("grid_time", F.when(duration > 0, C.grid_time(F.col("start"), duration, F.col("tick"), _n(steps))))


def grid_long(bars: DataFrame, onsets: DataFrame, start: float = 0.0, duration: float = 1e12, lengths: tuple[int, ...] = (1, 2, 4), patterns: DataFrame | None = None, steps: Steps = STEPS, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, methods: tuple[str, ...] | None = None) -> DataFrame:
    """The canonical table: every method's rows on the complete grid, with onset, phase and grid time where present.

    patterns: track_id, method, L of detected periods, which are methods beside the fixed lengths. Duplicated ticks keep
    every row. Grid points without an onset have null onset and phase. A column of steps goes along as the last one.

    methods: those that are wanted (default: all); only their parts are worked out.

    keep: called with each part that several methods need and its name; a function that writes it and reads it again
    makes each part be worked out once.
    """
    def wanted(*names: str) -> bool:
        return methods is None or any(n in methods for n in names)

    long = [*LONG, *_along(steps)]
    lengths = tuple(n for n in lengths if wanted(f"standard_L{n}"))
    if patterns is not None and methods is not None:
        patterns = patterns.where(F.col("method").isin(*methods))
    bars = keep(bars, "bars")
    ranges = keep(snippet_bars(bars, start, duration), "ranges")
    inside = clipped(bars, ranges)
    parts: list[DataFrame] = []
    plain = [m for m in ("uncorrected", "per_snippet", "per_snippet_remapped") if wanted(m)]
    if plain:
        refs = keep(snippet_references(bars, ranges, onsets, steps=steps), "references") if plain != ["uncorrected"] else None
        parts.append(_plain_methods(inside, onsets, refs, plain, steps).select(*long))
    # all lengths at once: one join of the bars with themselves, not one for each length
    sources = []
    if lengths:
        standard = loops(bars, ranges, F.explode(F.array(*map(F.lit, lengths))), steps)
        sources.append(standard.withColumn("method", F.concat(F.lit("standard_L"), F.col("L").cast("string"))))
    if patterns is not None:
        rows = bars.join(_by_key(patterns), "track_id").join(_by_key(ranges), "track_id")
        sources.append(_looped(rows.where("bar BETWEEN first_bar AND last_bar AND (bar - first_bar) % L = 0"), rows, ["track_id", "method", "L"], steps))
    if sources:
        # a length is worked out once, whichever methods use it
        looped = keep(reduce(DataFrame.unionByName, (s.withColumn("L", F.col("L").cast("int")) for s in sources)), "loops")
        by_length = looped.select("track_id", "L", *LOOP, *_along(steps)).distinct()
        references = keep(loop_references(by_length, onsets, steps=steps), "loop_references")
        users = keep(looped.select("track_id", "method", "L").distinct(), "users")
        parts.append(_loop_methods(inside, onsets, references, users, steps).select(*long))
    return reduce(DataFrame.unionByName, parts)


def _empty_ticks(taken: Column, steps: Steps) -> Column:
    """The ticks of a bar that an array of ticks lacks."""
    return F.array_except(F.sequence(F.lit(0), _n(steps) - 1), taken)


def _plain_methods(inside: DataFrame, onsets: DataFrame, refs: DataFrame | None, methods: list[str], steps: Steps) -> DataFrame:
    """The methods without loops: a bar is one row with its first onsets by tick until its grid points are told.

    Bars without onsets come along as bounds of the as-of join, so that no grid point has to be joined.
    """
    own = ["bar", "start", "end", *_along(steps)]
    duration = F.col("end") - F.col("start")
    placed = asof.with_bars(onsets.select("track_id", "t"), inside.select("track_id", *own))
    tick = C.nearest_tick(C.phase(F.col("t"), F.col("start"), duration), _n(steps))
    first = placed.withColumn("tick", F.when(F.col("t").isNotNull(), tick)).groupBy("track_id", *own, "tick").agg(F.min("t").alias("onset_time"))
    rows = first.groupBy("track_id", *own).agg(F.collect_list(F.when(F.col("tick").isNotNull(), F.struct("tick", "onset_time"))).alias("ticks"))  # at most `steps` members
    if refs is not None:
        rows = rows.join(_by_key(refs.select("track_id", (F.col("ref_ms") / 1000.0).alias("shift"))), "track_id", "left" if "uncorrected" in methods else "inner")
    else:
        rows = rows.withColumn("shift", F.lit(0.0))
    remapped = F.transform("ticks", lambda x: F.struct(C.nearest_tick(C.phase(x["onset_time"], F.col("start"), duration, F.col("shift")), _n(steps)).alias("tick"), x["onset_time"].alias("onset_time")))
    kinds = [F.struct(F.lit(m).alias("method"), (F.lit(0.0) if m == "uncorrected" else F.col("shift")).alias("shift"), (remapped if m == "per_snippet_remapped" else F.col("ticks")).alias("ticks")) for m in methods]
    rows = rows.withColumn("m", F.explode(F.array(*kinds))).select("track_id", *own, "m.method", "m.shift", "m.ticks")
    silent = F.transform(_empty_ticks(F.col("ticks.tick"), steps), lambda i: F.struct(i.alias("tick"), F.lit(None).cast("double").alias("onset_time")))
    rows = rows.where("shift IS NOT NULL").withColumn("p", F.explode(F.concat("ticks", silent))).select("track_id", *own, "method", "shift", "p.tick", "p.onset_time")
    p = C.phase(F.col("onset_time"), F.col("start"), duration, F.col("shift"))
    grid_time = F.when(duration > 0, C.grid_time(F.col("start"), duration, F.col("tick"), _n(steps))) + F.col("shift")
    return rows.withColumns({"phase": C.shifted(p, _n(steps)), "grid_time": grid_time, "L": F.lit(None).cast("int")})


def _loop_methods(inside: DataFrame, onsets: DataFrame, references: DataFrame, users: DataFrame, steps: Steps) -> DataFrame:
    """The methods by loops: onsets tell their own grid points, and a row for each bar those without onsets."""
    along = _along(steps)
    placed = _loop_onsets(references, onsets, steps)
    n = _n(steps)
    p = C.phase(F.col("t"), F.col("start"), F.col("bar_length"), F.col("ref_ms") / 1000.0)
    placed = placed.withColumn("tick", F.when(F.col("t").isNotNull(), C.nearest_tick(p, n)))

    def grid_time(tick: Column) -> Column:
        return F.col("loop_start") + (F.col("offset") * n + tick) * F.col("step") + F.col("ref_ms") / 1000.0

    sounding = placed.where("t IS NOT NULL").select("track_id", "L", "bar", "tick", F.col("t").alias("onset_time"), C.shifted(p, n).alias("phase"), grid_time(F.col("tick")).alias("grid_time"), *along)
    sounding = sounding.join(_by_key(users), ["track_id", "L"])
    place = ["loop_start", "offset", "step", "ref_ms"]
    taken = placed.groupBy("track_id", "L", "bar", *place).agg(F.collect_set("tick").alias("taken"))  # at most `steps` members
    every = inside.select("track_id", "bar", *along).join(_by_key(users), "track_id").join(_by_key(taken), ["track_id", "L", "bar"], "left")
    silent = every.withColumn("tick", F.explode(_empty_ticks(F.coalesce("taken", F.array().cast("array<int>")), steps)))
    silent = silent.withColumns({"grid_time": grid_time(F.col("tick")), "onset_time": F.lit(None).cast("double"), "phase": F.lit(None).cast("double")})
    own = ["track_id", "method", "L", "bar", "tick", "onset_time", "phase", "grid_time", *along]
    return sounding.select(*own).unionByName(silent.select(*own))


def grid_wide(long: DataFrame, methods: list[str], present: str | None = None) -> DataFrame:
    """One row per bar and tick; a phase and a grid-time column per method, the earliest onset where several share a tick.

    present: a column of that name tells the methods that have a row there, be it without phase and grid time.
    """

    def of(m: str, c: str) -> Column:
        return F.when(F.col("method") == m, F.col(c))

    cells = [x for m in methods for x in (F.min_by("phase", of(m, "onset_time")).alias(f"{m}_phase"), F.min(of(m, "grid_time")).alias(f"{m}_grid_time"))]
    if present is not None:
        cells.append(F.array_compact(F.array(*(F.when(F.max(F.col("method") == m), m) for m in methods))).alias(present))
    return long.groupBy("track_id", "bar", "tick").agg(*cells)
