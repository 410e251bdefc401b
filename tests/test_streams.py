"""Streams against the batch operators on the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from timegrid.operators import asof, bars, series
from timegrid.streaming import streams

BASE = dt.datetime(2024, 1, 1)


def rows_of(spark, times):
    return spark.createDataFrame([(k, BASE + dt.timedelta(seconds=t)) for k, t in times], "track_id long, ts timestamp")


def arriving(spark, path, rows, files, schema):
    """Rows (ts first as seconds after BASE, in UTC) as a stream of files, one in each micro-batch."""
    size = -(-len(rows) // files)
    for k in range(files):
        own = spark.createDataFrame([(*r[1:], r[0]) for r in rows[k * size : (k + 1) * size]], f"{schema}, s double")
        own.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000 + 1_704_067_200_000_000).cast("long"))).drop("s").coalesce(1).write.mode("append").parquet(path)
    types = spark.read.parquet(path).schema
    return spark.readStream.schema(types).option("maxFilesPerTrigger", 1).parquet(path)


def finished(stream, path, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return query


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_spacing_equals_batch(spark, tmp_path, zone):
    """Three micro-batches, late events among them, in three time zones; the last event only moves the watermark."""
    rng = random.Random(3)
    times = sorted(round(rng.uniform(0, 3000), 1) for _ in range(120))
    late = sorted(((t, k) for t in times for k in [rng.randrange(3)]), key=lambda x: x[0] + rng.uniform(-250, 250)) + [(9000.0, 9)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        name = f"spaced_{zone.replace('/', '_')}"
        query = finished(streams.spaced(arriving(spark, f"{tmp_path}/in", late, 3, "track_id long"), 45.0), tmp_path, name)
        got = {(r.track_id, r.us / 1e6 - 1_704_067_200) for r in spark.table(name).select("track_id", F.unix_micros("ts").alias("us")).collect()}
        batch = series.min_spacing(spark.createDataFrame([(k, t) for t, k in late if k != 9], "track_id long, t double"), 45.0)
        assert {(k, round(t, 6)) for k, t in got} == {(r.track_id, r.t) for r in batch.collect()}
        # state of the tracks that nothing waits for is gone
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_tracks_share_keys_of_state(spark, tmp_path):
    """Many tracks are a few keys of state; each is still spaced by itself."""
    times = [(float(t), k) for t in (0, 10, 50, 70) for k in range(300)] + [(9000.0, 0)]
    rows = streams.in_order(arriving(spark, f"{tmp_path}/in", times, 3, "track_id long").select("track_id", "ts", F.unix_micros("ts").alias("us"), F.lit(0).cast("long").alias("kind"), F.lit(0).cast("long").alias("id")), lambda memory, us, kind, number: [(us,)], "us long", lambda memory, passed: False, "10 minutes", buckets=8)
    query = finished(rows, tmp_path, "shared")
    assert spark.table("shared").groupBy("track_id").count().where("count = 4").count() == 300
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) == 8


def test_placed_equals_batch_from_files_out_of_order(spark, tmp_path):
    rng = random.Random(8)
    points = [(round(rng.uniform(0, 3000), 1), rng.randrange(2), i) for i in range(200)]
    bounds = [(t, k, -1) for t, k, _ in rng.sample(points, 30)] + [(1500.0, 1, -1), (1500.0, 1, -1)]
    rows = sorted(points + bounds, key=lambda r: r[0] + rng.uniform(-250, 250)) + [(9000.0, 9, 999)]
    events = arriving(spark, f"{tmp_path}/in", rows, 3, "track_id long, id long")
    finished(streams.placed(events.where("id >= 0"), events.where("id < 0")), tmp_path, "placed")
    got = {(r.track_id, r.id, round(r.a / 1e6, 1), round(r.b / 1e6, 1)) for r in spark.table("placed").select("track_id", "id", (F.unix_micros("start") - 1_704_067_200_000_000).alias("a"), (F.unix_micros("end") - 1_704_067_200_000_000).alias("b")).collect()}
    own = bars.bars(spark.createDataFrame([(k, t) for t, k, _ in bounds], "track_id long, t double"))
    batch = asof.in_bars(spark.createDataFrame([(k, t, i) for t, k, i in points], "track_id long, t double, id long"), own)
    assert got == {(r.track_id, r.id, r.start, r.end) for r in batch.collect()} and len(got) > 100


def test_files_are_processed_once(spark, tmp_path):
    def run():
        q = streams.incremental(spark, f"{tmp_path}/in", "track_id long, ts timestamp", f"{tmp_path}/out", f"{tmp_path}/c", lambda b: b.groupBy("track_id").count())
        q.awaitTermination(120)

    rows_of(spark, [(1, 1.0), (1, 2.0)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    rows_of(spark, [(2, 1.0)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.track_id, r["count"]) for r in out.collect()} == {(1, 2), (2, 1)}


def test_window_tempo(spark, tmp_path):
    own = rows_of(spark, [(1, 10.0), (1, 20.0), (1, 4000.0), (1, 9000.0)]).withColumn("tempo_bpm", F.minute("ts") + F.second("ts") + 100.0)
    own.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.window_tempo(spark.readStream.schema(own.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("tempo").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.n_bars, r.mean_bpm) for r in spark.table("tempo").orderBy("start").collect()][:1] == [(2, 115.0)]
