"""Scalar functions of the timing operators: Column in, Column out, all built-in expressions.

Nulls give null unless a function says otherwise. ANSI mode is assumed: every division is guarded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

STEPS = 16


def by_track() -> WindowSpec:
    """The window of a track's rows."""
    return Window.partitionBy("track_id")


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bar_tempo(duration: Column, beats: int | Column = 4, least: float = 1e-6) -> Column:
    """Beats per minute of a bar; bars no longer than `least` have tempo 0."""
    return F.when(duration > least, F.lit(60.0) / duration * lit(beats)).otherwise(F.lit(0.0))


def tempo_class(bpm: Column, base: Column, tolerance: float = 0.10) -> Column:
    """half, double or normal by the inclusive bands around half and twice the base; half is tested first."""
    half = bpm.between(base * (0.5 * (1.0 - tolerance)), base * (0.5 * (1.0 + tolerance)))
    double = bpm.between(base * (2.0 * (1.0 - tolerance)), base * (2.0 * (1.0 + tolerance)))
    return F.when(half, "half").when(double, "double").otherwise("normal")


def within_percent(value: Column, base: Column, share: float = 0.10) -> Column:
    return value.between(base * (1.0 - share), base * (1.0 + share))


def repair_action(kind: Column, dominant: Column, orientation: Column) -> Column:
    """What to do with a bar of a class, given the track's dominant class."""
    usual = F.when(kind == "double", "merge").when(kind == "half", "split").otherwise("unchanged")
    factor = F.when((kind == "normal") & (orientation == "double"), "split").when((kind == "normal") & (orientation == "half"), "merge").otherwise("unchanged")
    return F.when(dominant == "normal", usual).when(dominant == "factor2", factor).otherwise("unchanged")


def usable_base(raw: Column, dominant: Column, orientation: Column, override: Column) -> Column:
    factor = F.when((dominant == "factor2") & (orientation == "double"), 2.0).when((dominant == "factor2") & (orientation == "half"), 0.5).otherwise(1.0)
    return F.coalesce(override, raw * factor)


def nearest_tick(phase: Column, steps: int | Column = STEPS) -> Column:
    """Tick by half-even rounding, clamped into the bar."""
    return F.least(F.greatest(F.rint(phase * lit(steps)), F.lit(0.0)), lit(steps) - 1.0).cast("int")


def phase(onset: Column, start: Column, duration: Column, reference: Column | float = 0.0) -> Column:
    """Position in the bar as a share of it, after a shift of the grid by `reference` seconds."""
    return F.when(duration > 0, (onset - (start + lit(reference))) / duration)


def shifted(p: Column, steps: int | Column = STEPS) -> Column:
    """The phase as it is stored, one step later."""
    return p + F.lit(1.0) / lit(steps)


def grid_time(start: Column, duration: Column, tick: Column, steps: int | Column = STEPS) -> Column:
    return start + tick * (duration / lit(steps).cast("double"))


def nearest_fraction(p: Column, steps: int | Column = STEPS) -> Column:
    """The nearest of 0/steps .. (steps-1)/steps; the lower one of two."""
    n = lit(steps).cast("double")
    return F.least(F.greatest(F.ceil(p * n - 0.5), F.lit(0)), lit(steps) - 1) / n


def deviation_ms(onset: Column, grid: Column) -> Column:
    return (onset - grid) * 1000.0


def improvement(base: Column, corrected: Column) -> Column:
    return F.when(base == 0, F.lit(0.0)).otherwise((base - corrected) / F.nullif(base, F.lit(0.0)) * 100.0)


def unit_phase(x: Column) -> Column:
    return F.pmod(x, F.lit(1.0))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def in_id_range(name: Column, low: int | None, high: int | None) -> Column:
    """No range: true; a name that is no number: false; bounds are inclusive."""
    if low is None or high is None:
        return F.lit(True)
    return F.coalesce(name.try_cast("int").between(low, high), F.lit(False))


def note_of(hz: Column) -> Column:
    """Number of the note of a frequency, in 0..127."""
    return F.when(hz > 0, F.least(F.greatest(F.rint(F.log2(hz / 440.0) * 12.0 + 69.0), F.lit(0.0)), F.lit(127.0)).cast("int"))


def song_id(name: Column) -> Column:
    return F.when(F.instr(name, "_") > 0, F.substring_index(name, "_", 1)).otherwise(name)


def song_info(name: Column) -> Column:
    return F.when(F.instr(name, "_") > 0, F.substr(name, F.instr(name, "_") + 1)).otherwise(name)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def combined_activation(beat: Column, down: Column) -> tuple[Column, Column]:
    return F.greatest(beat - down, F.lit(0.0)), down


def equal_frames(frames: Column, n: int) -> Column:
    """An array of any length at n places, from its first on and without the end, by linear interpolation; empty: zeros.

    Places after the last element have its value.
    """
    size = F.size(frames)

    def one(i: Column) -> Column:
        at = i * size / F.lit(float(n))
        k = F.floor(at).cast("int")
        here = F.get(frames, k)
        return here + (F.get(frames, F.least(k + 1, size - 1)) - here) * (at - k)

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)).otherwise(F.array_repeat(F.lit(0.0), n))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it; expressions named in a lambda are worked out anew at each call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def circular_correlation(a: Column, b: Column, step: int = 1) -> Column:
    """Largest normalised circular correlation of two arrays over shifts 0, step, ...; 0 if one of them is all zero."""

    def dot(shift: Column) -> Column:
        rolled = F.concat(F.slice(b, F.size(b) - shift + 1, shift), F.slice(b, F.lit(1), F.size(b) - shift))
        return F.aggregate(F.zip_with(a, rolled, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def norm(x: Column) -> Column:
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))

    shifts = F.sequence(F.lit(0), F.size(a) - 1, F.lit(step))
    return let(norm(a) * norm(b), lambda scale: F.when(scale > 0, F.array_max(F.transform(shifts, dot)) / F.nullif(scale, F.lit(0.0))).otherwise(F.lit(0.0)))


def register(spark: SparkSession) -> None:
    """SQL names for the scalar functions, as SQL functions that Catalyst inlines."""
    for name, args, body in (
        ("bar_tempo", "duration DOUBLE, beats INT", "CASE WHEN duration > 1e-6D THEN 60D / duration * beats ELSE 0D END"),
        ("nearest_tick", "phase DOUBLE, steps INT", "CAST(least(greatest(rint(phase * steps), 0D), steps - 1D) AS INT)"),
        ("nearest_fraction", "phase DOUBLE", "least(greatest(ceil(phase * 16 - 0.5D), 0), 15) / 16D"),
        ("unit_phase", "x DOUBLE", "pmod(x, 1D)"),
        ("note_of", "hz DOUBLE", "CASE WHEN hz > 0 THEN CAST(least(greatest(rint(log2(hz / 440D) * 12 + 69), 0D), 127D) AS INT) END"),
        ("safe_divide", "a DOUBLE, b DOUBLE", "coalesce(try_divide(a, b), 0D)"),
    ):
        kind = "INT" if name in ("nearest_tick", "note_of") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
