"""Long tracks cut into ranges of time, so that no task has to hold one.

A track with more than `rows` rows is cut: its time is divided into equal slices, slices that still hold more are
divided again, up to LEVELS times, and consecutive slices of about `rows` rows make a range. Windows then go over track
and range. What a window would have carried over from other ranges is worked out apart, as one row for each range, and
joined. Other tracks are a range of their own.

Rows of one time stay together; a time that alone has more than `rows` rows isn't cut. The tables of cuts have a row
for every rows / FINENESS rows of long tracks at most; they are sent to all executors while they have at most
BROADCAST_ROWS rows, and joined by key beyond.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timegrid.sources import scratch

#: Slices for each range that is wanted.
FINENESS = 64
LEVELS = 3
#: Bits of a slice's number that a level takes.
BITS = 20
BROADCAST_ROWS = 200_000
ROWS = 1 << 20
RANGE = "_range"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _slice(time: Column) -> Column:
    """The slice of a time in a cell (low, width, slices), from 1."""
    place = F.floor((time - F.col("low")) / F.col("width"))
    return F.least(F.greatest(place, F.lit(0)), F.col("slices") - 1) + 1


def _inside(cell: Column, number: Column) -> Column:
    return F.shiftleft(cell, BITS).bitwiseOR(number)


@dataclass
class Cuts:
    """levels: tables of cells that are divided (key, cell, low, width, slices). slices: key, cell, range of the others.

    ranges: key, range. count: rows of slices.
    """

    key: str
    levels: list[DataFrame]
    slices: DataFrame
    ranges: DataFrame
    count: int

    def _celled(self, df: DataFrame, time: Column) -> DataFrame:
        rows = df.withColumn("cell", F.lit(0).cast("long"))
        for level in self.levels:
            inner = F.when(F.col("width").isNotNull(), _inside(F.col("cell"), _slice(time))).otherwise(F.col("cell"))
            rows = rows.join(level, [self.key, "cell"], "left").select(*df.columns, inner.alias("cell"))
        return rows

    def placed(self, df: DataFrame, time: str) -> DataFrame:
        """df (without columns cell, low, width and slices) with `_range`, -1 for tracks that aren't cut.

        Times that weren't counted lie in the slices around them.
        """
        slices = self.slices.select(self.key, "cell", F.col("range").alias(RANGE))
        rows = self._celled(df, F.col(time)).join(slices, [self.key, "cell"], "left")
        return rows.select(*df.columns, F.coalesce(RANGE, F.lit(-1)).alias(RANGE))

    def _edges(self, rows: DataFrame, of: Column, back: bool) -> DataFrame:
        """For each range what the aggregate `of` gives for the nearest range before (after) it that has any."""
        own = rows.where(f"{RANGE} >= 0").groupBy(self.key, RANGE).agg(of.alias("_edge"))
        every = self.ranges.select(self.key, F.col("range").alias(RANGE)).join(own, [self.key, RANGE], "left")
        # a frame up to the end of a window is worked out anew for each row, so what follows is looked back on from there
        order = Window.partitionBy(self.key).orderBy(RANGE if back else F.desc(RANGE))
        carried = F.last("_edge", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        return every.select(self.key, RANGE, carried.alias("_edge"))

    def _window(self, order: list[str]):
        return Window.partitionBy(self.key, RANGE).orderBy(*order)

    def last(self, rows: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
        """rows with `name`, the last non-null value at or before a row of its track."""
        edges = self._edges(rows.where(F.col(value).isNotNull()), F.max_by(value, F.struct(*order)), True)
        local = F.last(value, ignorenulls=True).over(self._window(order).rowsBetween(Window.unboundedPreceding, 0))
        return self._with(rows.withColumn("_local", local), edges, F.coalesce("_local", "_edge"), name)

    def first(self, rows: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
        """rows with `name`, the first non-null value at or after a row of its track."""
        edges = self._edges(rows.where(F.col(value).isNotNull()), F.min_by(value, F.struct(*order)), False)
        backwards = Window.partitionBy(self.key, RANGE).orderBy(*map(F.desc, order))
        local = F.last(value, ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
        return self._with(rows.withColumn("_local", local), edges, F.coalesce("_local", "_edge"), name)

    def lead(self, rows: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
        """rows with `name`, the value of the row after a row in its track; values aren't null."""
        edges = self._edges(rows, F.min_by(value, F.struct(*order)), False)
        local = F.lead(value).over(self._window(order))
        return self._with(rows.withColumn("_local", local), edges, F.coalesce("_local", "_edge"), name)

    def numbered(self, rows: DataFrame, order: list[str], name: str) -> DataFrame:
        """rows with `name`, their number in their track from 1."""
        own = rows.where(f"{RANGE} >= 0").groupBy(self.key, RANGE).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(self.key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        edges = own.select(self.key, RANGE, F.sum("_n").over(before).alias("_edge"))
        return self._with(rows.withColumn("_local", F.row_number().over(self._window(order))), edges, F.col("_local") + F.coalesce("_edge", F.lit(0)), name)

    def _with(self, rows: DataFrame, edges: DataFrame, value: Column, name: str) -> DataFrame:
        kept = [c for c in rows.columns if c not in ("_local", name)]
        return rows.join(_small(edges, self.count), [self.key, RANGE], "left").select(*kept, value.alias(name))


def cuts(tables: list[tuple[DataFrame, str]], rows: int = ROWS, key: str = "track_id", keep: Callable[[DataFrame, str], DataFrame] = scratch.written) -> Cuts:
    """Where to cut the tracks of tables (each with the name of its time column), by two passes over their times."""
    times = reduce(DataFrame.unionByName, (t.select(key, F.col(c).cast("double").alias("t")) for t, c in tables)).where("t IS NOT NULL")
    levels: list[DataFrame] = []
    cells = times.withColumn("cell", F.lit(0).cast("long"))
    total = 0
    while len(levels) < LEVELS:
        sizes = cells.groupBy(key, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("low"), F.max("t").alias("high"))
        n = F.least(F.ceil(F.col("n") / rows) * FINENESS, F.lit((1 << BITS) - 1)).cast("long")
        long = sizes.where((F.col("n") > rows) & (F.col("high") > F.col("low"))).withColumn("slices", n)
        level = keep(long.select(key, "cell", "low", ((F.col("high") - F.col("low")) / F.col("slices")).alias("width"), "slices").where("width > 0"), "cells")
        count, made = level.agg(F.count(F.lit(1)), F.sum("slices")).first()
        if not count:
            break
        total += made
        levels.append(_small(level, count))
        cells = cells.join(levels[-1], [key, "cell"]).select(key, "t", _inside(F.col("cell"), _slice(F.col("t"))).alias("cell"))
    if not levels:
        none = keep(times.limit(0).select(key, F.lit(0).cast("long").alias("cell"), F.lit(0).alias("range")), "slices")
        return Cuts(key, [], none, none.select(key, "range"), 0)
    made = Cuts(key, levels, levels[0], levels[0], total)
    number = F.explode(F.sequence(F.lit(1), F.col("slices"))).alias("number")
    parts = []
    for i, level in enumerate(levels):
        inner = level.select(key, "cell", "low", "width", number).select(key, _inside(F.col("cell"), F.col("number")).alias("cell"), (F.col("low") + (F.col("number") - 1) * F.col("width")).alias("start"))
        parts.append(inner.join(levels[i + 1], [key, "cell"], "left_anti") if i + 1 < len(levels) else inner)
    filled = made._celled(times, F.col("t")).where("cell > 0").groupBy(key, "cell").agg(F.count(F.lit(1)).alias("n"))
    every = reduce(DataFrame.unionByName, parts).join(filled, [key, "cell"], "left")
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(key).orderBy("start", "cell").rowsBetween(Window.unboundedPreceding, -1))
    slices = keep(every.select(key, "cell", F.floor(F.coalesce(before, F.lit(0)) / rows).cast("int").alias("range")), "slices")
    return Cuts(key, levels, _small(slices, total), slices.select(key, "range").distinct(), total)
