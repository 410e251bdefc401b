"""Pattern lengths: lag similarity of bars and information criteria over bar lengths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timegrid.functions import cols as C
from timegrid.functions.cols import by_track
from timegrid.operators import asof

#: Lags 1, 2, 4, 8 are chosen from; a lag's neighbours tell whether it is a maximum.
MAX_LAG = 9
#: Frames of a bar that several channels are compared at, and the norm below which a channel is silent.
FRAMES = 64
SILENT = 1e-9


def bar_vectors(onsets: DataFrame, bars: DataFrame, bins: int = 16) -> DataFrame:
    """Per bar an array of 0 and 1: whether an onset falls into each of `bins` equal parts; silent bars are all 0."""
    placed = asof.with_bars(onsets.select("track_id", "t"), bars.select("track_id", "bar", "start", "end"))
    length = F.col("end") - F.col("start")
    part = F.when((length > 0) & F.col("t").isNotNull(), F.least(F.floor((F.col("t") - F.col("start")) / length * bins), F.lit(bins - 1)).cast("int"))
    found = placed.groupBy("track_id", "bar").agg(F.collect_set(part).alias("parts"))  # at most `bins` members
    vector = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.array_contains(F.col("parts"), i).cast("double"))
    return found.select("track_id", "bar", vector.alias("v"))


def lag_pairs(vectors: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Pairs of bars of a track that are 1 to max_lag apart: each bar goes once into a window of its track by number."""
    ahead = Window.partitionBy("track_id").orderBy(F.col("bar").cast("long")).rangeBetween(1, max_lag)
    later = F.collect_list(F.struct(F.col("bar").alias("other"), F.col("v").alias("b"))).over(ahead)
    rows = vectors.withColumn("_later", later).withColumnRenamed("v", "a").select("*", F.explode("_later").alias("_pair"))
    return rows.select("*", "_pair.*", (F.col("_pair.other") - F.col("bar")).cast("int").alias("lag")).drop("_later", "_pair")


def lag_profile(pairs: DataFrame, similarity: Column, mean: bool = False) -> DataFrame:
    """Median (or mean) similarity by track and lag, to nine decimals, so that rounding doesn't break ties."""
    value = F.avg("s") if mean else F.percentile("s", 0.5)
    return pairs.withColumn("s", similarity).groupBy("track_id", "lag").agg(F.round(value, 9).alias("value"))


def power_of_two(profile: DataFrame) -> DataFrame:
    """Per track the best of the lags 2, 4, 8 that are local maxima, else of 1, 2, 4, 8; the smallest of equals."""
    order = by_track().orderBy("lag")
    v, before, after = F.col("value"), F.lag("value").over(order), F.lead("value").over(order)
    peak = F.when(before.isNull(), v > after).when(after.isNull(), v > before).otherwise((v >= before) & (v >= after) & ((v > before) | (v > after)))
    rows = profile.withColumn("peak", F.coalesce(peak, F.lit(False))).where(F.col("lag").isin(1, 2, 4, 8))
    best = F.max_by(F.when(F.col("peak") & (F.col("lag") > 1), F.col("lag")), F.when(F.col("peak") & (F.col("lag") > 1), F.struct("value", -F.col("lag"))))
    return rows.groupBy("track_id").agg(F.coalesce(best, F.max_by("lag", F.struct("value", -F.col("lag")))).cast("int").alias("L"))


def onset_period(onsets: DataFrame, bars: DataFrame, beats: int = 4, bins: int = 16) -> DataFrame:
    """Period of the onset pattern. The dot products are of whole numbers, so they are exact."""
    pairs = lag_pairs(bar_vectors(onsets, bars, bins))
    return power_of_two(lag_profile(pairs, C.circular_correlation(F.col("a"), F.col("b"), max(1, bins // beats))))


def resampled(values: DataFrame, bars: DataFrame, n: int = 16, closed: bool = True) -> DataFrame:
    """Per bar the voiced values (> 0) between its first and last, by linear interpolation at n equal places.

    closed: the last place is the last value's; otherwise the end is left out. Bars without voiced values are all 0.
    """
    inside = asof.with_bars(values.where("value > 0").select("track_id", "t", "value"), bars.select("track_id", "bar", "start", "end"))
    # a bar's own row has no time; it comes first
    order = Window.partitionBy("track_id", "bar").orderBy("t", "value")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t, y, after, next_y, t0, t1 = map(F.col, ("t", "value", "_after", "_next", "_t0", "_t1"))
    spans = inside.select("track_id", "bar", "t", "value", F.lead("t").over(order).alias("_after"), F.lead("value").over(order).alias("_next"), F.min("t").over(whole).alias("_t0"), F.max("t").over(whole).alias("_t1"))
    step = (t1 - t0) / float(n - 1 if closed else n)
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), (F.when(i == n - 1, t1).otherwise(t0 + i * step) if closed else t0 + i * step).alias("g")))
    # a point answers for the places from its time up to the next one's
    own = F.filter(places, lambda p: (p["g"] >= t) & (after.isNull() | (p["g"] < after)))
    value = F.transform(own, lambda p: F.struct(p["i"].alias("i"), F.when((p["g"] > t) & after.isNotNull(), y + (next_y - y) * ((p["g"] - t) / F.nullif(after - t, F.lit(0.0)))).otherwise(y).alias("y")))
    rows = spans.select("track_id", "bar", value.alias("own")).groupBy("track_id", "bar").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("own"))  # n members
    return rows.select("track_id", "bar", F.when(F.size("own") == 0, F.array_repeat(F.lit(0.0), n)).otherwise(F.transform("own", lambda x: x["y"])).alias("v"))


def standardised(v: Column) -> Column:
    """Less the mean, over the population deviation (never 0)."""
    def about(v: Column, mean: Column) -> Column:
        variance = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(v)
        return C.let(F.sqrt(variance) + 1e-9, lambda deviation: F.transform(v, lambda x: (x - mean) / deviation))

    return C.let(v, lambda v: C.let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v), lambda mean: about(v, mean)))


def contour_period(values: DataFrame, bars: DataFrame, beats: int = 4, n: int = 16) -> DataFrame:
    """Period of a value series: standardised contours, rotations at beats, similarities never negative."""
    vectors = resampled(values, bars, n).withColumn("v", F.transform(standardised(F.col("v")), lambda x: F.round(x, 9)))
    similarity = F.greatest(F.lit(0.0), C.circular_correlation(F.col("a"), F.col("b"), max(1, round(n / beats))))
    return power_of_two(lag_profile(lag_pairs(vectors), similarity))


def _correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest normalised circular correlation of stacked bars (bars, channels, frames), by one transform of all.

    The channels' correlations add up, and so do their norms. Channels whose norm is next to nothing in either bar are
    left out.
    """
    n, m = np.linalg.norm(a, axis=2), np.linalg.norm(b, axis=2)
    used = (n >= SILENT) & (m >= SILENT)
    product = (np.fft.rfft(a, axis=2) * np.conj(np.fft.rfft(b, axis=2)) * used[:, :, None]).sum(axis=1)
    scale = (n * m * used).sum(axis=1)
    return np.fft.irfft(product, n=a.shape[2], axis=1).max(axis=1) / np.where(scale > 0, scale, 1.0)


def _by_shape(a: pd.Series, b: pd.Series, cells) -> pd.Series:
    """Correlations of pairs of arrays; pairs of one shape are stacked, those of unlike or no shape are 0."""
    out, shapes = np.zeros(len(a)), {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = cells(x), cells(y)
        if x is not None and y is not None:
            m = min(len(x), len(y))
            if m and x.shape[1] and x.shape[1] == y.shape[1]:
                shapes.setdefault((m, x.shape[1]), []).append((i, x[:m], y[:m]))
    for pairs in shapes.values():
        at, left, right = zip(*pairs, strict=True)
        out[list(at)] = _correlations(np.stack(left), np.stack(right))
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def fourier_correlation(a: pd.Series, b: pd.Series) -> pd.Series:
    """Largest normalised circular correlation of long arrays of equal length, by Fourier transforms."""
    return _by_shape(a, b, lambda x: None if x is None else np.asarray(x, float)[None, :])


@F.pandas_udf(T.DoubleType())
def channel_correlation(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same over several channels (arrays of arrays of equal length)."""
    return _by_shape(a, b, lambda x: None if x is None or not len(x) or len({len(c) for c in x}) > 1 else np.stack([np.asarray(c, float) for c in x]))


def multichannel_period(frames: DataFrame, n: int = FRAMES) -> DataFrame:
    """Period of frames in several channels (track_id, bar, channel, frames); a bar's channels are one array.

    Bars may have any number of frames: each is interpolated to n of them.
    """
    order = F.array_sort(F.collect_list(F.struct("channel", C.equal_frames(F.col("frames"), n).alias("frames"))))
    bars = frames.groupBy("track_id", "bar").agg(F.transform(order, lambda x: x["frames"]).alias("v"))
    return power_of_two(lag_profile(lag_pairs(bars), channel_correlation("a", "b")))


def channel_profile(frames: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Lag profile of feature frames (track_id, bar, frames)."""
    return lag_profile(lag_pairs(frames.withColumnRenamed("frames", "v"), max_lag), fourier_correlation("a", "b"))


def channel_period(frames: DataFrame) -> DataFrame:
    return power_of_two(channel_profile(frames))


def _criteria(bars: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Per track and candidate length: n, the squared error of bar-length differences about their phases' means."""
    d = (F.col("end") - F.col("start")) * 1000.0
    rows = bars.withColumn("d", d - F.lag(d).over(by_track().orderBy("bar"))).withColumn("i", F.row_number().over(by_track().orderBy("bar")))
    rows = rows.where("d IS NOT NULL").select("track_id", "i", "d", F.explode(F.array(*map(F.lit, lengths))).alias("L"))
    rows = rows.withColumn("r", F.col("i") % F.col("L"))
    means = rows.groupBy("track_id", "L", "r").agg(F.avg("d").alias("mu"))
    centre = means.groupBy("track_id", "L").agg((F.sum("mu") / F.col("L")).alias("m"))  # phases without values count as 0
    joined = rows.join(means, ["track_id", "L", "r"]).join(centre, ["track_id", "L"])
    e = F.col("d") - (F.col("mu") - F.col("m"))
    return joined.groupBy("track_id", "L").agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"))


def bic(bars: DataFrame, lengths: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """n ln(sse / n) + (L - 1) ln n; minus infinity for no error at all."""
    n = F.col("n").cast("double")
    score = F.when(F.col("sse") > 0, n * F.ln(F.col("sse") / n) + (F.col("L") - 1) * F.ln(n)).otherwise(F.lit(float("-inf")))
    return _criteria(bars, lengths).withColumn("score", score)


def aicc(bars: DataFrame, lengths: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """n ln(sse / n) + 2 L + 2 L (L + 1) / (n - L - 1), infinite while n <= L + 1; null for no error at all."""
    n, k = F.col("n").cast("double"), F.col("L").cast("double")
    score = F.when(F.col("n") <= F.col("L") + 1, F.lit(float("inf"))).when(F.col("sse") > 0, n * F.ln(F.col("sse") / n) + 2 * k + 2 * k * (k + 1) / F.nullif(n - k - 1, F.lit(0.0)))
    return _criteria(bars, lengths).withColumn("score", score)


def bic_period(scores: DataFrame) -> DataFrame:
    return scores.groupBy("track_id").agg(F.min_by("L", F.struct("score", "L")).alias("L"))


def aicc_period(scores: DataFrame, tolerance: float = 2.0, default: int = 4) -> DataFrame:
    """The smallest length whose score is less than `tolerance` above the best; the default if a score is undefined."""
    least = F.min("score").over(by_track())
    undefined = F.count_if(F.col("score").isNull()).over(by_track()) > 0
    near = F.when(F.col("score") == least, True).otherwise(F.col("score") - least < tolerance)
    rows = scores.withColumn("near", F.coalesce(near, F.lit(False))).withColumn("undefined", undefined)
    return rows.groupBy("track_id").agg(F.when(F.max("undefined"), F.lit(default)).otherwise(F.min(F.when(F.col("near"), F.col("L")))).cast("int").alias("L"))


def all_methods(onsets: DataFrame, values: DataFrame, bars: DataFrame, default: int = 4, frames: DataFrame | None = None, n_frames: int = FRAMES, pitch: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Every method's length for every track that has bars: track_id, method, L; the default where one finds none.

    frames: those of multichannel_period, for the method mel. pitch: a second value series, for the method pitch.
    keep: called with the bars, which every method reads, and with the lengths; a function that writes and reads them
    again makes each be worked out once.
    """
    bars = keep(bars, "bars")
    found = {"onset": onset_period(onsets, bars), "contour": contour_period(values, bars), "bic": bic_period(bic(bars)), "aicc": aicc_period(aicc(bars))}
    if frames is not None:
        found["mel"] = multichannel_period(frames, n_frames)
    if pitch is not None:
        found["pitch"] = contour_period(pitch, bars)
    rows = reduce(DataFrame.unionByName, (df.select("track_id", "L").withColumn("method", F.lit(m)) for m, df in found.items()))
    every = bars.select("track_id").distinct().withColumn("method", F.explode(F.array(*map(F.lit, found))))
    return keep(every.join(rows, ["track_id", "method"], "left").select("track_id", "method", F.coalesce("L", F.lit(default)).alias("L")), "lengths")


def consensus(patterns: DataFrame, default: int = 4) -> DataFrame:
    """The most common length of a track's methods; the smallest of equally common ones."""
    counted = patterns.groupBy("track_id", "L").agg(F.count("L").alias("c"))
    return counted.groupBy("track_id").agg(F.coalesce(F.max_by("L", F.struct("c", -F.col("L"))), F.lit(default)).alias("L"))
