"""Streaming forms: incremental arrival, minimum spacing, as-of assignment to bars, tempo over windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def incremental(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs a batch operator on every file that arrives in source, once, and resumes after a stop.

    A batch writes to a folder of its own number, so a batch that is run again after a failure replaces its own output.
    """

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


Fold = Callable[[list, int, int, int], list[tuple]]


#: Keys of state that tracks are dealt over by hash: a key costs milliseconds in Python, however little it holds.
BUCKETS = 1024


def in_order(events: DataFrame, fold: Fold, output: str, keep: Callable[[list, int], bool], watermark: str, buckets: int = BUCKETS) -> DataFrame:
    """Folds each track's events (track_id, us, kind, id, and ts with the same instants) in order of time, however they arrive.

    An event waits in state until the watermark has passed it, so no earlier one can follow, and is then given to fold
    with the track's memory, a list of numbers; what fold returns are rows of `output` after track_id. Equal times go by
    kind, then id. A track's state is removed once nothing waits and keep(memory, watermark in microseconds) says that the
    memory isn't needed any more. A key of state is a bucket of tracks; a timer wakes it when the watermark reaches the
    next event of one of them. A task holds one bucket at a time, so more tracks than millions want more buckets.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memories: dict[int, list[int]] = {}
        waiting: dict[int, list[tuple]] = {}
        if state.exists:
            owners, numbers, *old = state.get
            for track, number in zip(owners, numbers, strict=True):
                memories.setdefault(track, []).append(number)
            for track, *event in zip(*old, strict=True):
                waiting.setdefault(track, []).append(tuple(event))
        for frame in frames:
            for track, *event in zip(*(frame[c].tolist() for c in ("track_id", "us", "kind", "id")), strict=True):
                waiting.setdefault(track, []).append(tuple(event))
        passed = state.getCurrentWatermarkMs() * 1000
        out, wakes = [], []
        held: list[tuple] = []
        later: list[tuple] = []
        for track in memories.keys() | waiting.keys():
            memory, own, n = memories.get(track, []), sorted(waiting.get(track, [])), 0
            while n < len(own) and own[n][0] <= passed:
                out += ((track, *row) for row in fold(memory, *own[n]))
                n += 1
            if n < len(own) or keep(memory, passed):
                held += ((track, x) for x in memory)
                later += ((track, *x) for x in own[n:])
                wakes.append(own[n][0] if n < len(own) else memory[-1])
        if wakes:
            state.update((*([x[i] for x in held] for i in range(2)), *([x[i] for x in later] for i in range(4))))
            # the timer must lie after the watermark, in milliseconds
            state.setTimeoutTimestamp(max(passed // 1000 + 1, min(wakes) // 1000 + 1))
        elif state.exists:
            state.remove()
        names = [c.split()[0] for c in output.split(", ")]
        yield pd.DataFrame(out, columns=["track_id", *names])

    rows = events.withWatermark("ts", watermark).withColumn("bucket", F.pmod(F.xxhash64("track_id"), F.lit(buckets))).groupBy("bucket")
    types = ", ".join(f"{c} array<bigint>" for c in ("owner", "memory", "track", "us", "kind", "id"))
    return rows.applyInPandasWithState(step, f"track_id long, {output}", types, "append", GroupStateTimeout.EventTimeTimeout)


def spaced(events: DataFrame, least: float, watermark: str = "10 minutes") -> DataFrame:
    """Greedy minimum spacing on a stream (track_id, ts): keeps events `least` seconds after the last kept one.

    Events are taken once the watermark has passed them; older ones that come then are dropped by Spark. Times are
    instants, whatever the session's time zone. A track's memory is the last kept time, until it hinders no event more.
    """
    gap = round(least * 1e6)

    def fold(memory: list, us: int, kind: int, number: int) -> list[tuple]:
        if memory and us - memory[0] < gap:
            return []
        memory[:] = [us]
        return [(us,)]

    def keep(memory: list, passed: int) -> bool:
        return bool(memory) and passed < memory[0] + gap

    rows = events.select("track_id", "ts", F.unix_micros("ts").alias("us"), F.lit(0).cast("long").alias("kind"), F.lit(0).cast("long").alias("id"))
    return in_order(rows, fold, "us long", keep, watermark).select("track_id", F.timestamp_micros("us").alias("ts"))


def placed(points: DataFrame, boundaries: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """As-of assignment on streams: points (track_id, ts, id) in the bars that boundaries (track_id, ts) make.

    Both may come late and in any order within the watermark. A point is given out with its bar's start and end when the
    boundary after it is passed; until then the points of the open bar are a track's memory.
    """

    def fold(memory: list, us: int, kind: int, number: int) -> list[tuple]:
        if kind:
            if memory:
                memory.extend((number, us))
            return []
        out = [(i, at, memory[0], us) for i, at in zip(memory[1::2], memory[2::2], strict=True)] if memory and us > memory[0] else []
        if not memory or us > memory[0]:
            memory[:] = [us]
        return out

    def of(df: DataFrame, kind: int, number) -> DataFrame:
        return df.select("track_id", "ts", F.unix_micros("ts").alias("us"), F.lit(kind).cast("long").alias("kind"), number.cast("long").alias("id"))

    both = of(boundaries, 0, F.lit(0)).unionByName(of(points, 1, F.col("id")))
    rows = in_order(both, fold, "id long, us long, start_us long, end_us long", lambda memory, passed: bool(memory), watermark)
    return rows.select("track_id", "id", *(F.timestamp_micros(f"{c}us").alias(name) for c, name in (("", "ts"), ("start_", "start"), ("end_", "end"))))


def window_tempo(bars: DataFrame, length: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Mean tempo by track and time window of a stream of bars (track_id, ts, tempo_bpm)."""
    rows = bars.withWatermark("ts", watermark).groupBy("track_id", F.window("ts", length))
    return rows.agg(F.count(F.lit(1)).alias("n_bars"), F.avg("tempo_bpm").alias("mean_bpm")).select("track_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_bars", "mean_bpm")
