"""Audit of how text filters interact: what each removes in every order, what it would remove alone, and what it costs.

Five filters judge a document: A too few words, B too few distinct words, C too many capitals, D table or code marks,
E another document with a smaller id has the same text. The five answers are a mask; counts of documents by part and
mask tell everything about all 120 orders of the filters.

The counts come from a stream over the table's files, in available-now micro-batches. A text is a key of state, which
holds the smallest id seen, its mask and its part. A document that arrives with a larger id is counted as a copy; one
with a smaller id takes over: the mask counted for the earlier one is retracted and counted anew with E. Counts, also
negative ones, are written by batch, in a folder of the batch's number, so a batch that runs again replaces its own.

Scale: a text is a 32-byte digest from the scan on, so no text is shuffled. Of each run of rows only those with the
smallest id of a text go to that text's state; all others are copies for certain and are summed up at once, so a text
that fills a third of the table sends a row for each run. State lies in Spark's state store. A key of it costs
milliseconds in Python whatever it holds, so the states of the texts whose digests fall into the same of many buckets
lie under one key, packed; there is a bucket for every BUCKET_BYTES of files, so none grows with the table.

Defined cases: null texts are empty, and empty texts are equal texts; documents without an id neither are copies nor
make any; rows of equal id and text aren't copies of each other; null sources are the part ''; a document's label is
the smallest of its labels, and one without counts as neither good nor toxic; an empty table gives no rows.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timegrid.llm.common import BLANKS, fresh_dir, save

FILTERS = "ABCDE"
COPY = 16
#: Micro-batches that the table's files are dealt over.
BATCHES = 6
#: Bytes of the table's files for each bucket of texts.
BUCKET_BYTES = 8 << 20
BUCKETS = 48
_COUNTS = "part string, good int, toxic int, mask int, n long"
_WHO = ["part", "good", "toxic"]
_HELD = ["digest", "doc_id", *_WHO, "mask", "n"]


def mask(text: Column, words: Column) -> Column:
    """Which of the filters A to D a text fails, as the bits 1, 2, 4 and 8."""
    n, length = F.size(words), F.length(text)
    fails = (
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * length,
        text.rlike("[#$%&*|]"),
    )
    total = F.lit(0)
    for bit, failed in enumerate(fails):
        total = total + F.when(failed, 1 << bit).otherwise(0)
    return total


def facts(docs: DataFrame) -> DataFrame:
    """Of each document its id, part, mask of A to D, and the digest of its text."""
    t = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumn("w", F.filter(F.split("t", BLANKS), lambda x: x != ""))
    return t.select("doc_id", "part", mask(F.col("t"), F.col("w")).alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest"))


def _settled(buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of each run of rows: candidates with their text's digest, and sums of all that is settled, without."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            least = rows.groupby("digest", sort=False)["doc_id"].transform("min")
            free = rows["doc_id"].isna()
            first = ~free & (rows["doc_id"] == least)
            rows["mask"] += (COPY * (~free & ~first)).astype("int32")
            rows["bucket"] = rows["digest"].map(lambda d: int.from_bytes(d[:6], "little") % buckets).astype("int64")
            gone = ["digest", "doc_id"]
            rows[gone] = rows[gone].where(first)
            # sums go where the first of their rows would have gone
            rows["bucket"] = rows["bucket"].where(first, rows.groupby([*_WHO, "mask"], sort=False)["bucket"].transform("first"))
            out = rows.groupby(["bucket", *gone, *_WHO, "mask"], sort=False, dropna=False).size().rename("n").reset_index()
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return work


def _summed(rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    return rows.groupby(by, sort=False)["n"].sum().reset_index()


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of the counts by what has arrived for a bucket's texts."""
    rows = pd.concat(list(frames))
    settled = rows[rows["digest"].isna()]
    new = rows[rows["digest"].notna()]
    new = new.assign(doc_id=new["doc_id"].astype("int64"))[_HELD]
    old = pd.read_feather(io.BytesIO(state.get[0])) if state.exists else new.iloc[:0]
    both = pd.concat([old, new], ignore_index=True)
    least = both.groupby("digest", sort=False)["doc_id"].transform("min")
    first = both["doc_id"] == least
    copies = both.assign(mask=both["mask"] + (COPY * ~first).astype("int32"))
    # rows of before that are first no more: taken back, and counted as copies
    lost = both.iloc[: len(old)][~first.iloc[: len(old)]]
    changes = [settled, copies.iloc[len(old) :], lost.assign(n=-lost["n"]), copies.loc[lost.index]]
    if len(new):
        kept, held = both[first], io.BytesIO()
        _summed(kept, _HELD[:-1]).to_feather(held, compression="zstd")
        state.update((held.getvalue(),))
    yield _summed(pd.concat(changes), [*_WHO, "mask"])


def _length(spark: SparkSession, path: str) -> int:
    """Bytes of a table's files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def _source(path: str, files: list[str]) -> str:
    """path as a stream takes it: a single file must come as a pattern, here of its last letter."""
    path = path.rstrip("/")
    alone = len(files) == 1 and files[0].endswith("/" + path.rpartition("/")[2])
    return f"{path[:-1]}[{path[-1]}]" if alone else path


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Documents by part and mask: part, mask, n, good, toxic. path: a Parquet table (doc_id, source, text)."""
    table = spark.read.parquet(path)
    work = fresh_dir(spark, "audit")
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    known = save(known.select(F.col("doc_id").alias("_id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"), F.lit(0).alias("_salt")), "labels")
    files = table.inputFiles()
    buckets = max(BUCKETS, _length(spark, path) // BUCKET_BYTES)
    each = max(1, math.ceil(len(files) / batches))
    arriving = facts(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", each).parquet(_source(path, files)))
    # rows without an id have no label and shall not meet in one task
    salted = arriving.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    labelled = salted.join(known, (F.col("doc_id") == F.col("_id")) & (F.col("salt") == F.col("_salt")), "left")
    zero = F.lit(0)
    rows = labelled.select("digest", "doc_id", "part", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"), "mask")
    candidates = rows.mapInPandas(_settled(buckets), f"bucket long, digest binary, doc_id long, {_COUNTS}")
    changes = candidates.groupBy("bucket").applyInPandasWithState(_step, _COUNTS, "texts binary", "append", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{work}/counts/batch={number}")

    spark.createDataFrame([], _COUNTS).write.parquet(f"{work}/counts/batch=-1")
    changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.schema(_COUNTS).parquet(f"{work}/counts")
    of = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    return counts.groupBy("part", "mask").agg(*of).where("n > 0")


def report(counts: DataFrame) -> DataFrame:
    """All orders of the filters, step by step, of each part."""
    entries = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))  # 32 at most
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    rows = entries.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = F.transform(F.split("filter_order", ""), lambda c: F.call_function("shiftleft", F.lit(1), F.ascii(c) - ord("A")))
    rows = rows.withColumn("bits", bits).withColumn("own", F.get("bits", F.col("step") - 1))
    rows = rows.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a.bitwiseOR(b)))

    def total(value, holds) -> Column:
        return F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + F.when(holds(e["mask"]), value(e)).otherwise(0))

    def removed(m: Column) -> Column:
        return (m.bitwiseAND(F.col("own")) != 0) & (m.bitwiseAND(F.col("before")) == 0)

    # in 120 / k of the orders a filter is the first of the k that a document fails
    share = lambda e: e["n"] * F.call_function("div", F.lit(math.factorial(len(FILTERS))), F.bit_count(e["mask"]))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda e: e["n"], lambda m: m.bitwiseAND(F.col("own").bitwiseOR(F.col("before"))) == 0).alias("kept"),
        total(lambda e: e["n"], removed).alias("removed"),
        total(lambda e: e["n"], lambda m: (m.bitwiseAND(F.col("own")) != 0) & (m.bitwiseAND(F.col("before")) != 0)).alias("redundant"),
        total(lambda e: e["n"], lambda m: m == F.col("own")).alias("unique_fails"),
        total(lambda e: e["good"], removed).alias("good_lost"), total(lambda e: e["toxic"], removed).alias("toxic_lost"),
        total(share, lambda m: m.bitwiseAND(F.col("own")) != 0).alias("shapley"),
    )


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return report(counters(spark, path, labels, batches))
