"""Summaries of the long grid: RMS deviations, rhythm histograms, folds, distributions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timegrid.functions import cols as C

STEPS = C.STEPS


def _n(steps: int | str) -> Column:
    """The steps of a bar: a number for all, or a row's column of that name."""
    return F.col(steps) if isinstance(steps, str) else F.lit(steps)


def rms(long: DataFrame, steps: int | str = STEPS) -> DataFrame:
    """RMS deviation by track and method, as a phase and in ms.

    A row's deviation is that of its stored phase from the nearest fraction of the bar. In ms it is taken times the
    bar's duration, as its grid times tell: (largest - smallest) * steps / (steps - 1), or 2 s with less than two rows.
    0 where there are no onsets.
    """
    n = _n(steps)
    dev = F.when(F.col("onset_time").isNotNull(), F.col("phase") - C.nearest_fraction(F.col("phase"), n))
    span = (F.max("grid_time") - F.min("grid_time")) * (F.first(n) / F.nullif(F.first(n) - 1, F.lit(0)))
    # sums by bar: its rows are added up where they are made, and one for each goes on
    bars = long.groupBy("track_id", "method", "bar").agg(F.count(dev).alias("n"), F.sum(dev * dev).alias("s"), F.when(F.count("grid_time") >= 2, span).otherwise(F.lit(2.0)).alias("dur"))
    ms = F.col("s") * (F.col("dur") * 1000.0) * (F.col("dur") * 1000.0)
    total = F.nullif(F.sum("n"), F.lit(0))
    return bars.groupBy("track_id", "method").agg(
        F.sum("n").alias("n"), F.coalesce(F.sqrt(F.sum("s") / total), F.lit(0.0)).alias("rms_phase"), F.coalesce(F.sqrt(F.sum(ms) / total), F.lit(0.0)).alias("rms_ms")
    )


def phase_rms(phases: DataFrame, keys: list[str], steps: int | str = STEPS) -> DataFrame:
    dev = F.col("phase") - C.nearest_fraction(F.col("phase"), _n(steps))
    return phases.groupBy(*keys).agg(F.count("phase").alias("n"), F.coalesce(F.sqrt(F.avg(dev * dev)), F.lit(0.0)).alias("rms_phase"))


def rms_summary(by_method: DataFrame, methods: list[str], base: str = "uncorrected", equal: float = 1e-9) -> DataFrame:
    """Per track the methods' RMS in ms, their improvement over the base, and the best (the first of equals).

    Equal to the least are those at most `equal` above it: the same deviations added up in another order differ in the
    last digits, and rounding would still tell apart two sums on either side of a rounding edge.
    """

    def of(m: str) -> Column:
        return F.max(F.when(F.col("method") == m, F.col("rms_ms")))

    rows = by_method.where(F.col("method").isin(methods)).groupBy("track_id").agg(*(of(m).alias(f"{m}_ms") for m in methods))
    least = F.array_min(F.array(*(F.col(f"{m}_ms") for m in methods)))
    best = F.coalesce(*(F.when(F.col(f"{m}_ms") - least <= equal, m) for m in methods))
    gains = [C.improvement(F.col(f"{base}_ms"), F.col(f"{m}_ms")).alias(f"{m}_gain") for m in methods if m != base]
    return rows.withColumn("best", best).select("*", *gains)


def rhythm_histogram(ticks: DataFrame, length: int, steps: int = STEPS) -> DataFrame:
    """Onsets by 1-based position in a pattern of `length` bars, per track, zero-filled. ticks: bar from the start, tick."""
    position = (F.col("bar") % length) * steps + F.col("tick") + 1
    counted = ticks.groupBy("track_id", position.cast("int").alias("position")).agg(F.count(F.lit(1)).alias("n"))
    every = ticks.select("track_id").distinct().withColumn("position", F.explode(F.sequence(F.lit(1), F.lit(length * steps))))
    return every.join(counted, ["track_id", "position"], "left").select("track_id", "position", F.coalesce("n", F.lit(0)).alias("n"))


def corpus_histogram(histograms: DataFrame) -> DataFrame:
    """Sum over tracks by position, with totals, occupied positions and the largest count on each row."""
    every = Window.partitionBy(F.lit(0))
    rows = histograms.groupBy("position").agg(F.sum("n").alias("n"))  # as many rows as positions
    return rows.withColumn("total", F.sum("n").over(every)).withColumn("occupied", F.count_if(F.col("n") > 0).over(every)).withColumn("largest", F.max("n").over(every))


def pattern_fold(long: DataFrame, length: int, steps: int = STEPS) -> DataFrame:
    """Deviations in ms by loop and 1-based position; loops that the track's bars don't fill are left out."""
    track = Window.partitionBy("track_id")
    bar = F.col("bar") - F.min("bar").over(track)
    n_bars = F.max("bar").over(track) - F.min("bar").over(track) + 1
    rows = long.select("track_id", bar.alias("b"), n_bars.alias("n_bars"), "tick", "onset_time", "grid_time")
    rows = rows.withColumn("loop", F.floor(F.col("b") / length).cast("int")).where(F.col("loop") < F.floor(F.col("n_bars") / length)).where("onset_time IS NOT NULL AND grid_time IS NOT NULL")
    position = (F.col("b") % length) * steps + F.col("tick") + 1
    return rows.select("track_id", "loop", position.cast("int").alias("position"), C.deviation_ms(F.col("onset_time"), F.col("grid_time")).alias("deviation_ms"))


def fold_rms(fold: DataFrame) -> DataFrame:
    return fold.groupBy("track_id").agg(F.count("deviation_ms").alias("n"), F.coalesce(F.sqrt(F.avg(F.col("deviation_ms") * F.col("deviation_ms"))), F.lit(0.0)).alias("rms_ms"))


def length_distribution(patterns: DataFrame) -> DataFrame:
    """Per method how many tracks have each length, and their percentage."""
    counted = patterns.groupBy("method", "L").agg(F.count(F.lit(1)).alias("tracks"))
    return counted.withColumn("percent", F.col("tracks") * 100.0 / F.sum("tracks").over(Window.partitionBy("method")))


def spread(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, median, least and largest value."""
    return rows.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("least"), F.max(value).alias("largest"))


def exact_percentile(rows: DataFrame, keys: list[str], value: str, q: float = 0.5, accuracy: int = 10_000) -> DataFrame:
    """The q-th percentile of a value by keys, exact and interpolated, for groups of any size: keys, n, value.

    `percentile` holds all distinct values of a group in one buffer. Here a sketch of bounded size gives values on both
    sides of the rank first. A second pass counts what lies below, and counts by value what lies between, some
    thousandths of a group at most but for repeats; only these are put in order.
    """
    data = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    margin = 2.0 / accuracy
    ends = F.percentile_approx("_v", [max(0.0, q - margin), min(1.0, q + margin)], accuracy)
    bounds = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ends.alias("_ends")).select(*keys, "n", F.get("_ends", F.lit(0)).alias("_low"), F.get("_ends", F.lit(1)).alias("_high"))
    known = data.join(bounds, keys) if keys else data.join(F.broadcast(bounds))  # one row
    v = F.col("_v")
    around = known.groupBy(*keys).agg(F.count_if(v < F.col("_low")).alias("_below"), F.max(F.when(v < F.col("_low"), v)).alias("_before"), F.min(F.when(v > F.col("_high"), v)).alias("_after"))
    inside = known.where(v.between(F.col("_low"), F.col("_high"))).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("_end", F.sum("_c").over(order))

    def with_keys(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, keys) if keys else a.join(F.broadcast(b))

    ranked = with_keys(with_keys(placed, bounds.select(*keys, "n")), around)
    start = F.col("_below") + F.col("_end") - F.col("_c")
    rank = F.floor((F.col("n") - 1) * q)

    def at(r: Column) -> Column:
        here = F.max(F.when((start <= r) & (r < F.col("_below") + F.col("_end")), v))
        return F.coalesce(here, F.max(F.when(r < F.col("_below"), F.col("_before"))), F.max("_after"))

    found = ranked.groupBy(*keys, "n").agg(at(rank).alias("_a"), at(rank + 1).alias("_b"))
    share = (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return found.select(*keys, "n", F.when(share > 0, F.col("_a") + (F.col("_b") - F.col("_a")) * share).otherwise(F.col("_a")).alias(value))


#: Fixed value: data sets whose downbeats aren't annotated.
WITHOUT_DOWNBEATS = ("smc",)


def with_downbeats(rows: DataFrame, dataset: str = "dataset", kind: str = "kind", without: tuple = WITHOUT_DOWNBEATS) -> DataFrame:
    """Scores (dataset, kind of beat or downbeat) less those of downbeats in data sets that have none."""
    return rows.where((F.col(kind) != "downbeat") | ~F.col(dataset).cast("string").isin([str(x) for x in without]))


def weighted_means(rows: DataFrame, keys: list[str], value: str = "value", weight: str = "n") -> DataFrame:
    """Running means by key put together: sum of value times n over sum of n; null where that is 0."""
    total = F.sum(weight)
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), total).alias("mean"), total.alias("weight"))


def corpus_filter(bars: DataFrame, least: int = 12) -> DataFrame:
    """The bars of tracks that have `least` bars at least."""
    return bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("track_id"))).where(F.col("_n") >= least).drop("_n")


def comparison_series(by_method: DataFrame, methods: list[str]) -> DataFrame:
    """Tracks that have RMS values, a column per method, 0 where a method is absent."""
    rows = by_method.where("rms_ms IS NOT NULL").groupBy("track_id").pivot("method", methods).agg(F.max("rms_ms"))
    return rows.select("track_id", *(F.coalesce(m, F.lit(0.0)).alias(m) for m in methods))
