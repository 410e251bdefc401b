"""Lookups, batch reports and bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup_by_priority(names: DataFrame, overview: DataFrame, default: float = 0.0) -> DataFrame:
    """An offset for each name from the overview (song_id, songname, offset): the first key that matches wins.

    Keys in order: the name as an id, its part before _ as a number's text, the whole name in lower case as a song name,
    its part before ' - ' without an id prefix likewise. Of overview rows with one key the smallest offset counts.
    """
    part = F.trim(F.regexp_replace(F.substring_index(F.lower("name"), " - ", 1), r"^\d+[_ ]+", ""))
    prefix = F.substring_index("name", "_", 1)
    keys = F.array(
        F.struct(F.lit(1).alias("prio"), F.concat(F.lit("id:"), F.col("name")).alias("key")),
        F.struct(F.lit(2).alias("prio"), F.when(prefix.rlike(r"^\d+$"), F.concat(F.lit("id:"), prefix)).alias("key")),
        F.struct(F.lit(3).alias("prio"), F.concat(F.lit("name:"), F.lower("name")).alias("key")),
        F.struct(F.lit(4).alias("prio"), F.concat(F.lit("name:"), part).alias("key")),
    )
    asked = names.select("name").distinct().withColumn("k", F.explode(keys)).select("name", "k.prio", "k.key").where("key IS NOT NULL")
    known = overview.select(F.explode(F.array(F.concat(F.lit("id:"), F.col("song_id").cast("string")), F.concat(F.lit("name:"), F.lower("songname")))).alias("key"), "offset")
    known = known.where("key IS NOT NULL").groupBy("key").agg(F.min("offset").alias("offset"))
    best = asked.join(known, "key").groupBy("name").agg(F.min_by("offset", "prio").alias("offset"))
    return names.select("name").join(best, "name", "left").withColumn("offset", F.coalesce("offset", F.lit(default)))


def lookup_with_default(rows: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """rows with the table's value by key, or the default. The optimiser broadcasts the table only if it is small."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def not_done(tracks: DataFrame, done: DataFrame, key: str = "track_id") -> DataFrame:
    return tracks.join(done.select(key).distinct(), key, "left_anti")


def batch_summary(results: DataFrame) -> DataFrame:
    """A row per track of parsed result files: id, raw and corrected bars, onsets, success, first five errors."""
    return results.select(
        "track_id", F.col("correction.raw_bars").alias("raw_bars"), F.col("correction.corrected_bars").alias("corrected_bars"), F.col("onsets.count").alias("onsets"),
        (F.coalesce(F.size("errors"), F.lit(0)) <= 0).alias("ok"), F.slice(F.coalesce("errors", F.array().cast("array<string>")), 1, 5).alias("errors"), F.size(F.coalesce("steps_completed", F.array().cast("array<string>"))).alias("steps"),
    )


def outcome_counts(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def validation_report(tracks: DataFrame, checks: dict) -> DataFrame:
    """Per row the names of the checks (name: boolean Column) that fail, in order, and of those that pass."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    passed = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return tracks.withColumn("errors", failed).withColumn("steps_completed", passed)


def preview(rows: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def top_per_key(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)
