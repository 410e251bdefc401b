"""Evaluation of predicted events against annotated ones, by the usual definitions of beat evaluation."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timegrid.functions import cols as C
from timegrid.functions.cols import by_track
from timegrid.operators import asof


def matches(predicted: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """A largest set of pairs (track_id, p, a, error) no farther apart than the tolerance, each event in one at most.

    A scan of both sides in order of time pairs each event with the earliest free one of the other side, which is best
    on a line. It holds the events of one side within the tolerance, so a track may be of any length.
    """
    key = dict(predicted.dtypes)["track_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, side, free = object(), 0, deque()
        for batch in batches:
            keys, times, sides = batch.column("track_id"), batch.column("t").to_pylist(), batch.column("side").to_pylist()
            found: list[tuple[int, float, float]] = []
            for i, (x, t, s) in enumerate(zip(keys.to_pylist(), times, sides, strict=True)):
                if x != track:
                    track, free = x, deque()
                while free and t - free[0] > tolerance:
                    free.popleft()
                if free and s != side:
                    other = free.popleft()
                    found.append((i, t, other) if s == 0 else (i, other, t))
                else:
                    side = s
                    free.append(t)
            at, p, a = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch({"track_id": keys.take(pa.array(at, pa.int64())), "p": pa.array(p, pa.float64()), "a": pa.array(a, pa.float64())})

    sides = [df.select("track_id", F.col("t").cast("double").alias("t"), F.lit(s).alias("side")).where("t IS NOT NULL") for s, df in enumerate((predicted, truth))]
    rows = sides[0].unionByName(sides[1]).repartition("track_id").sortWithinPartitions("track_id", "t", "side")
    return rows.mapInArrow(scan, f"track_id {key}, p double, a double").withColumn("error", F.col("p") - F.col("a"))


def f_measure(predicted: DataFrame, truth: DataFrame, tolerance: float = 0.07, least: int = 2) -> DataFrame:
    """2 TP / (2 TP + FP + FN) per track; tracks with fewer than `least` annotations are left out."""
    tp = matches(predicted, truth, tolerance).groupBy("track_id").agg(F.count(F.lit(1)).alias("tp"))
    n_true = truth.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_true")).where(F.col("n_true") >= least)
    n_predicted = predicted.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_predicted"))
    rows = n_true.join(n_predicted, "track_id", "left").join(tp, "track_id", "left").na.fill(0)
    return rows.withColumn("f", 2.0 * F.col("tp") / (F.col("n_true") + F.col("n_predicted")))


def _steps(events: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct events in order with their number and the step from the one before (of the first: to the second)."""
    order = Window.partitionBy(key).orderBy("t")
    rows = events.select(key, "t").where("t IS NOT NULL").distinct()
    step = F.coalesce(F.col("t") - F.lag("t").over(order), F.lead("t").over(order) - F.col("t"))
    return rows.select(key, F.col("t").alias(name), (F.row_number().over(order) - 1).alias(f"{name}_number"), step.alias(f"{name}_step"))


def continuity(predicted: DataFrame, truth: DataFrame, share: float = 0.175) -> DataFrame:
    """Per track cmlc and cmlt: right predictions in the longest unbroken run, and in all, as shares of the longer side.

    A prediction is right if it lies within `share` of the annotation's step from its nearest annotation (the later of
    two), and its own step differs from that step by no more than `share` of it. A step is that from the event before,
    of a first event that to the next. With fewer than two events on a side both are 0.
    """
    a, p = _steps(truth, "track_id", "a"), _steps(predicted, "track_id", "p")
    near = asof.nearest(p, a, "p", "a", later=True).select("track_id", "p_number", "p_step", "distance", F.col("nearest").alias("a"))
    near = near.join(a, ["track_id", "a"])
    right = (F.col("distance") <= F.col("a_step") * share) & (F.abs(1 - F.try_divide(F.col("p_step"), F.col("a_step"))) <= share)
    run = F.col("p_number") - F.row_number().over(by_track().orderBy("p_number"))
    runs = near.where(right).withColumn("run", run).groupBy("track_id", "run").agg(F.count(F.lit(1)).alias("n"))
    found = runs.groupBy("track_id").agg(F.max("n").alias("longest"), F.sum("n").alias("right"))
    n_true = a.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_true"))
    n_pred = p.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_pred"))
    rows = n_true.join(n_pred, "track_id", "left").join(found, "track_id", "left").na.fill(0, ["n_pred", "longest", "right"])
    enough = (F.col("n_true") > 1) & (F.col("n_pred") > 1)

    def of(n: str) -> Column:
        return F.when(enough, F.col(n) / F.greatest("n_true", "n_pred")).otherwise(F.lit(0.0))

    return rows.select("track_id", of("longest").alias("cmlc"), of("right").alias("cmlt"))


def variants(truth: DataFrame) -> DataFrame:
    """The annotations and their other metrical levels: between the beats, 2 and 3 times as fast, every 2nd and 3rd."""
    order = by_track().orderBy("t")
    rows = truth.select("track_id", "t").where("t IS NOT NULL").distinct()
    rows = rows.withColumn("k", F.row_number().over(order) - 1).withColumn("d", F.lead("t").over(order) - F.col("t"))
    t, d, k = F.col("t"), F.col("d"), F.col("k")
    of = [("same", t), ("offbeat", t + d * 0.5), ("double", t), ("double", t + d * 0.5), ("triple", t), ("triple", t + d / 3.0), ("triple", t + d * 2.0 / 3.0)]
    points = [F.struct(F.lit(name).alias("variant"), at.alias("t")) for name, at in of]
    points += [F.struct(F.concat(F.lit(f"every_{n}_"), (k % n).cast("string")).alias("variant"), t.alias("t")) for n in (2, 3)]
    return rows.select("track_id", F.explode(F.array(*points)).alias("v")).select("track_id", "v.variant", "v.t").where("t IS NOT NULL")


def levels(predicted: DataFrame, truth: DataFrame, share: float = 0.175) -> DataFrame:
    """Per track cmlc, cmlt, and amlc, amlt: the best over all metrical levels, of which others count if cmlc is no more than .5.

    All levels are compared at once, as tracks of their own.
    """
    own = variants(truth).select(F.struct("track_id", "variant").alias("track_id"), "t")
    keys = own.select("track_id").distinct()
    repeated = keys.select("track_id", F.col("track_id.track_id").alias("own")).join(predicted.select(F.col("track_id").alias("own"), "t"), "own").select("track_id", "t")
    scores = continuity(repeated, own, share).select("track_id.*", "cmlc", "cmlt")
    same = F.col("variant") == "same"

    def best(c: str) -> Column:
        main = F.max(F.when(same, F.col(c)))
        return F.when(F.max(F.when(same, F.col("cmlc"))) > 0.5, main).otherwise(F.max(c))

    return scores.groupBy("track_id").agg(F.max(F.when(same, F.col("cmlc"))).alias("cmlc"), F.max(F.when(same, F.col("cmlt"))).alias("cmlt"), best("cmlc").alias("amlc"), best("cmlt").alias("amlt"))


def binary_accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rows (logit, truth) whose sigmoid is at .5 or above just when truth is above .6; truth -1 is masked."""
    weight = (F.col("truth") != -1).cast("double")
    right = ((C.sigmoid(F.col("logit")) >= 0.5) == (F.col("truth") > 0.6)).cast("double")
    return rows.groupBy(*keys).agg((F.sum(right * weight) / (F.sum(weight) + 1e-4)).alias("accuracy"))


def error_counts(scores: DataFrame, key: str, score: str) -> DataFrame:
    """Per dataset how many tracks have no score."""
    return scores.groupBy(key).agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col(score).isNull()).alias("errors"))
