"""The given tables, read as keyed event streams.

Users are tracks; a track's time is hours since the start of 2024. Clicks are its boundaries, all events its onsets,
clicks and views its beats. Orders are a second stream: customers by day, with several orders on some days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOURS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 3.6e9D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), "event_id", F.expr(HOURS).alias("t"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value series: value of each event, at its time."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), "event_id", F.expr(HOURS).alias("t"), "value")


def downbeats(spark: SparkSession, sf_dir: str, kind: str = "click") -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.select(F.col("user_id").alias("track_id"), F.expr(HOURS).alias("t")).distinct()


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return rows.select(F.col("user_id").alias("track_id"), F.expr(HOURS).alias("t")).distinct()


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries with ties: a customer's order days, kept apart by the order's key."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("tie"), F.expr("cast(datediff(o_orderdate, DATE'1990-01-01') AS double)").alias("t"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature frames: label is the track, the rank of vec_id the bar, the vector 64 frames of one channel."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("track_id"), rank.alias("bar"), F.expr("transform(embedding, x -> cast(x AS double))").alias("frames"))
