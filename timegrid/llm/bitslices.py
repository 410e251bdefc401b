"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers. The index deals the rows by hash into segments of bounded size; in a segment every
attribute is stored, less its smallest value, as bit slices: bitmaps that hold one binary digit of all its rows. The
score of all rows for a query is a sum of slices, each as often as the query's component says: bitmaps of equal
weight are added three to two by carry-save adders until one slice is left for each binary digit of the score. The
top rows are then chosen from the most significant slice downward: rows that are above the boundary so far, and rows
still equal to it. Where more rows are equal to the last than there are places, the smaller vec_id wins. A negative
component adds the slices' complements. All sums are of integers, so scores are exact.

Queries go to the segments in blocks; each block and segment gives k rows a query at most, and a query's rows of all
segments are ranked again.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without
vec_id; vectors of unlike lengths have no inner product, so a query's candidates are those of its length; components so
large that a sum could pass 62 bits raise OverflowError; of rows that repeat a query's vec_id the smallest vector asks; a row with a query's own vec_id is not its candidate; rows that repeat a vec_id are
candidates each; with no queries or no candidates the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timegrid.llm.common import save

SCALE = 1024
SEGMENT_ROWS = 8192
QUERY_BLOCK = 128
#: Tasks that a search has at least, if there are so many pairs of blocks and segments.
LEAST_TASKS = 64
#: Tasks of a search at most; beyond, a task has several tiles.
MAX_TASKS = 20_000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and q: floor(scale * x) of each component, for vectors that take part."""
    good = F.expr("size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)
    return rows.select("vec_id", F.expr(f"transform(embedding, x -> cast(floor(cast(x AS double) * {scale}) AS long))").alias("q"))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words, the first row in the lowest bit."""
    wide = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // 64) * 64), np.uint8)
    wide[..., : bits.shape[-1]] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view("<u8")


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values: rows x attributes -> each attribute's smallest value, and its bit slices: attributes x digits x words."""
    low = values.min(axis=0)
    above = (values - low).T
    digits = max(1, int(above.max()).bit_length())
    return low, np.stack([packed((above >> d) & 1) for d in range(digits)], axis=1)


def add_slices(slices: np.ndarray, full: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """Slices of sum |q| * (value or its complement) for each query: a list by digit of arrays queries x words."""
    size, negative = np.abs(queries), queries < 0
    digits = max(1, int(size.max()).bit_length())
    columns: list[list[np.ndarray]] = [[] for _ in range(digits + slices.shape[1] + 24)]

    def put(at: int, bitmap: np.ndarray) -> None:
        while True:
            column = columns[at]
            column.append(bitmap)
            if len(column) < 3:
                return
            a, b, c = column
            both = a ^ b
            columns[at] = [both ^ c]
            bitmap = (a & b) | (both & c)  # carry
            at += 1

    for j in range(slices.shape[0]):
        flip = np.where(negative[:, j], FULL, np.uint64(0))[:, None]
        for d in range(slices.shape[1]):
            values = (slices[j, d][None, :] ^ flip) & full
            for e in range(digits):
                wanted = (size[:, j] >> e) & 1
                if wanted.any():
                    put(d + e, values & np.where(wanted, FULL, np.uint64(0))[:, None])
    out = []
    zero = np.zeros((len(queries), slices.shape[2]), np.uint64)
    for at in range(len(columns)):
        column = columns[at]
        if len(column) == 2:
            a, b = column
            columns[at] = [a ^ b]
            if at + 1 < len(columns):
                put(at + 1, a & b)
            column = columns[at]
        out.append(column[0] if column else zero)
    while len(out) > 1 and not out[-1].any():
        out.pop()
    return out


def top_rows(scores: list[np.ndarray], allowed: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the rows (bit positions) that are above the k-th score or equal to it."""
    above, equal = np.zeros_like(allowed), allowed.copy()
    for s in reversed(scores):
        both = above | (equal & s)
        n = np.bitwise_count(both).sum(axis=1, dtype=np.int64)[:, None]
        above = np.where(n <= k, both, above)
        equal = np.where(n > k, equal & s, np.where(n < k, equal & ~s, np.uint64(0)))
    chosen = np.unpackbits((above | equal).view(np.uint8), axis=1, bitorder="little")
    return [np.flatnonzero(r) for r in chosen]


INDEX = "segment int, n int, ids binary, low binary, dims int, digits int, slices binary"


def build(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The index of quantised rows (vec_id, q), a row per segment, as a table."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        values = np.array(table.column("q").combine_chunks().flatten().to_numpy()).reshape(len(ids), -1)[order]
        low, slices = slices_of(values)
        row = {"segment": table.column("segment")[0].as_py(), "n": len(ids), "ids": ids[order].astype("<i8").tobytes(), "low": low.astype("<i8").tobytes(), "dims": values.shape[1], "digits": slices.shape[1], "slices": slices.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("segment", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("dims", pa.int32()), ("digits", pa.int32()), ("slices", pa.binary())]))

    segments = max(1, -(-rows.count() // segment_rows))
    dealt = rows.withColumn("segment", F.pmod(F.xxhash64("vec_id"), F.lit(segments)).cast("int"))
    return save(dealt.groupBy("segment", F.size("q")).applyInArrow(run, INDEX), "bitslices")


def search(index: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """The k best rows of the index for each query (vec_id, q): query_id, rank, vec_id, score."""
    blocks = max(1, -(-queries.count() // block))
    asked = queries.select("vec_id", "q", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.size("q").alias("dims"))
    asked = asked.groupBy("dims", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "q"))).alias("queries"))
    # each block of queries to each segment of vectors of its length. What is sent about are the blocks, which have a
    # bounded size; a segment moves once, or `parts` times where there are fewer segments than tasks could be
    segments = index.groupBy("dims").agg(F.collect_list("segment").alias("segments"))  # a number for every SEGMENT_ROWS rows
    number = index.count()
    parts = max(1, min(blocks, -(-LEAST_TASKS // max(1, number))))
    tasks = max(1, min(MAX_TASKS, number * parts))
    sent = asked.join(F.broadcast(segments), "dims").withColumn("segment", F.explode("segments")).withColumn("part", F.col("block") % parts)
    sent = sent.select("dims", "segment", "part", "block", "queries").repartition(tasks, "dims", "segment", "part")
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "dims", "segment", "part")
    tiles = sent.join(held.hint("merge"), ["dims", "segment", "part"]).select("block", "segment", "queries", "ids", "low", "dims", "digits", "slices")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                tile = batch.slice(r, 1).to_pydict()
                ids = np.frombuffer(tile["ids"][0], "<i8")
                low = np.frombuffer(tile["low"][0], "<i8")
                slices = np.frombuffer(tile["slices"][0], "<u8").reshape(tile["dims"][0], tile["digits"][0], -1)
                full = packed(np.ones((1, len(ids)), bool))
                listed = [x for x in tile["queries"][0] if len(x["q"]) == len(low)]
                out: list[tuple[int, int, int]] = []
                for s in range(0, len(listed), 128):
                    part = listed[s : s + 128]
                    own = np.array([x["vec_id"] for x in part])
                    q = np.array([x["q"] for x in part], np.int64)
                    top = (1 << slices.shape[1]) - 1
                    # q * value = |q| * (value - low) + q * low, or for q < 0, |q| * (top - (value - low)) - |q| * top + q * low
                    base = q @ low + np.where(q < 0, q * top, 0).sum(axis=1)
                    sums = add_slices(slices, full, q)
                    allowed = np.repeat(full, len(part), axis=0)
                    for i, query in enumerate(own):
                        for row in range(np.searchsorted(ids, query), np.searchsorted(ids, query, side="right")):
                            allowed[i, row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
                    for i, rows in enumerate(top_rows(sums, allowed, k)):
                        word, bit = rows // 64, (rows % 64).astype(np.uint64)
                        score = base[i] + sum(((x[i, word] >> bit) & np.uint64(1)).astype(np.int64) << d for d, x in enumerate(sums))
                        best = np.lexsort((ids[rows], -score))[:k]
                        out += zip([int(own[i])] * len(best), ids[rows[best]].tolist(), score[best].tolist(), strict=True)
                columns = list(zip(*out, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = tiles.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by `every`; candidates are all other rows."""
    rows = save(quantised(vectors, scale), "quantised")
    largest, dims = rows.agg(F.max(F.aggregate("q", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))), F.max(F.size("q"))).first()
    if dims and dims * (2 * largest + 1) ** 2 >= 2.0**62:
        raise OverflowError("components are too large for sums of 64 bits")
    return search(build(rows), rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q")), k)
