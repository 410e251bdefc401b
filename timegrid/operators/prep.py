"""Training data for beat tracking: folds, frame labels, chunks, tempo labels, augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folds(items: DataFrame, n: int = 8, seed: int = 0, everywhere: tuple[str, ...] = ()) -> DataFrame:
    """A fold for each item (dataset, item): a dataset's items in seeded hash order, cut into n equal parts.

    What is left over goes to the last fold. Items of the datasets in `everywhere` are for testing only and get all
    folds. Ranks come from counts of hash buckets and a window inside each, so a large dataset isn't one window.
    """
    rows = items.withColumn("h", F.xxhash64(F.lit(seed), "item")).withColumn("bucket", F.shiftrightunsigned("h", 54))
    counts = rows.groupBy("dataset", "bucket").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("dataset")
    counts = counts.withColumn("before", F.sum("c").over(whole.orderBy("bucket")) - F.col("c")).withColumn("size", F.greatest(F.lit(1), F.floor(F.sum("c").over(whole) / n)))
    rank = F.row_number().over(Window.partitionBy("dataset", "bucket").orderBy(F.shiftleft("h", 0), "item")) - 1
    rows = rows.withColumn("rank", rank).join(counts.drop("c"), ["dataset", "bucket"])
    fold = F.least(F.floor((F.col("before") + F.col("rank")) / F.col("size")), F.lit(n - 1)).cast("int")
    only_test = F.col("dataset").isin(*everywhere) if everywhere else F.lit(False)
    each = F.when(only_test, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(fold))
    return rows.select("dataset", "item", F.explode(each).alias("fold"), only_test.alias("test_only"))


def roles(folded: DataFrame, n: int = 8) -> DataFrame:
    """For every split f the role of each item: test in fold f, validation in f + 1, else train; test-only never trains."""
    rows = folded.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    role = F.when(F.col("fold") == F.col("split"), "test").when(F.col("test_only"), F.lit(None)).when(F.col("fold") == (F.col("split") + 1) % n, "validation").otherwise("train")
    return rows.withColumn("role", role).where("role IS NOT NULL")


def frame_labels(events: DataFrame, fps: float, weights: tuple[float, ...] = (1.0, 0.5, 0.25)) -> DataFrame:
    """Labels of frames near events (track_id, t): full at the nearest frame, less beside it, the largest where they meet."""
    frame = F.rint(F.col("t") * fps).cast("long")
    near = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(weights[abs(d)]).alias("w")) for d in range(1 - len(weights), len(weights)))))
    rows = events.select("track_id", frame.alias("f"), near.alias("n")).select("track_id", (F.col("f") + F.col("n.d")).alias("frame"), F.col("n.w").alias("label"))
    return rows.where("frame >= 0").groupBy("track_id", "frame").agg(F.max("label").alias("label"))


def masked(labels: DataFrame, usable: Column) -> DataFrame:
    """-1 where the annotation can't be used."""
    return labels.withColumn("label", F.when(usable, F.coalesce("label", F.lit(0.0))).otherwise(F.lit(-1.0)))


def label_events(labels: DataFrame, fps: float, above: float = 0.5) -> DataFrame:
    """Times of the frames whose label is above a threshold."""
    return labels.where(F.col("label") > above).select("track_id", (F.col("frame") / fps).alias("t"))


def chunks(lengths: DataFrame, size: int) -> DataFrame:
    """Chunks [start, end) of items (track_id, n): whole steps of size, and one more that ends with the item if need be.

    Shorter items are one chunk.
    """
    n = F.col("n")
    last = (F.floor(n / size) - 1).cast("int")
    whole = F.transform(F.sequence(F.lit(0), last), lambda i: (i * size).cast("long"))
    starts = F.when(n <= size, F.array(F.lit(0).cast("long"))).when(n % size == 0, whole).otherwise(F.concat(whole, F.array((n - size).cast("long"))))
    rows = lengths.where(n > 0).select("track_id", "n", F.posexplode(starts).alias("chunk", "start"))
    return rows.select("track_id", "chunk", "start", F.least(F.col("start") + size, F.col("n")).alias("end"))


def tempo_labels(tempos: DataFrame, bins: int = 300) -> DataFrame:
    """Soft labels over tempo bins: 1 at the nearest bin, .5 and .25 beside it, scaled to sum 1; tempo out of range: none."""
    b = F.rint("bpm").cast("int")
    near = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(0.5 ** abs(d)).alias("w")) for d in range(-2, 3))))
    rows = tempos.where((b >= 0) & (b < bins)).select("track_id", b.alias("b"), near.alias("n")).select("track_id", (F.col("b") + F.col("n.d")).alias("bin"), F.col("n.w").alias("w"))
    rows = rows.where((F.col("bin") >= 0) & (F.col("bin") < bins))
    return rows.withColumn("label", F.col("w") / F.sum("w").over(Window.partitionBy("track_id"))).drop("w")


def interval_tempo(events: DataFrame, fps: float = 100.0, spread: int = 2) -> DataFrame:
    """Tempo of the most frequent interval between events: counts of frames, smoothed, with a parabola over the peak.

    -1 for tracks without an interval.
    """
    track = Window.partitionBy("track_id")
    d = F.rint((F.col("t") - F.lag("t").over(track.orderBy("t"))) * fps).cast("long")
    counts = events.withColumn("d", d).where(F.col("d") >= 1).groupBy("track_id", "d").agg(F.count(F.lit(1)).alias("c"))
    near = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(spread + 1 - abs(k))).alias("w")) for k in range(-spread, spread + 1))))
    smooth = counts.select("track_id", "d", "c", near.alias("n")).groupBy("track_id", (F.col("d") + F.col("n.k")).alias("bin")).agg(F.sum(F.col("c") * F.col("n.w")).alias("s"))
    best = smooth.groupBy("track_id").agg(F.max_by("bin", F.struct("s", -F.col("bin"))).alias("peak"))
    joined = smooth.join(best, "track_id").groupBy("track_id", "peak").agg(*(F.coalesce(F.max(F.when(F.col("bin") == F.col("peak") + k, F.col("s"))), F.lit(0.0)).alias(n) for k, n in ((-1, "a"), (0, "b"), (1, "c"))))
    bend = F.col("a") - 2 * F.col("b") + F.col("c")
    place = F.col("peak") + F.coalesce(F.try_divide(0.5 * (F.col("a") - F.col("c")), bend), F.lit(0.0))
    tempo = joined.select("track_id", F.when(place > 0, 60.0 * fps / place).otherwise(F.lit(-1.0)).alias("bpm"))
    return events.select("track_id").distinct().join(tempo, "track_id", "left").withColumn("bpm", F.coalesce("bpm", F.lit(-1.0)))


def mixed_channels(rows: DataFrame, key: str, channels: list[str], seed: int = 0) -> DataFrame:
    """Stem mixing: by a seeded draw per row, 5, 4, 3 or 2 channels (50, 30, 10, 10 %), pairs of arrays being summed.

    Adds `mix`, an array of channel arrays. Each merge sums two channels at seeded places and keeps the others in order.
    """

    def draw(n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(n), F.col(key)), F.lit(1000))

    keep = F.when(draw(0) < 500, 5).when(draw(0) < 800, 4).when(draw(0) < 900, 3).otherwise(2)
    rows = rows.withColumn("mix", F.array(*channels)).withColumn("_keep", F.least(keep, F.lit(len(channels))))
    for step in range(1, len(channels) - 1):
        size = F.size("mix")
        i = F.pmod(draw(2 * step), size).cast("int")
        j = F.pmod(i + 1 + F.pmod(draw(2 * step + 1), size - 1), size).cast("int")
        low, high = F.least(i, j), F.greatest(i, j)
        summed = F.zip_with(F.get("mix", low), F.get("mix", high), lambda a, b: a + b)
        merged = F.concat(F.slice("mix", F.lit(1), low), F.array(summed), F.slice("mix", low + 2, high - low - 1), F.slice("mix", high + 2, size))
        rows = rows.withColumn("mix", F.when(size > F.col("_keep"), merged).otherwise(F.col("mix")))
    return rows.drop("_keep")


def zipped(features: DataFrame, annotations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of equal (dataset, position) put together, and the datasets whose three counts differ."""
    rows = features.join(annotations, ["dataset", "position"]).join(names, ["dataset", "position"])
    kinds = [("features", features), ("annotations", annotations), ("names", names)]
    counts = None
    for kind, df in kinds:
        c = df.groupBy("dataset").agg(F.count(F.lit(1)).alias(kind))
        counts = c if counts is None else counts.join(c, "dataset", "full")
    counts = counts.na.fill(0)
    return rows, counts.where("features <> annotations OR features <> names")
