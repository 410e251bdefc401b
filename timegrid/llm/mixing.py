"""Mixing sources to target weights by Sainte-Laguë apportionment of equal word blocks.

Words are dealt out in blocks of `block` words. Each source has a target number of words; the blocks go to the
sources by highest quotients target / (2k + 1), then each source's blocks to its shards by highest quotients of the
shards' words. A shard lays its documents end to end in a seeded order, as a circle; it takes its quota as one run of
blocks that starts at a seeded block, so whole rounds repeat every document and the rest is a seeded choice.

Only DataFrame operations: sizes, sums and windows over (source, shard), and small tables by source and shard.

Defined cases: null or blank texts have size 0 and are never taken; a null source is a source of its own, the last;
a source without words has target 0; an empty table gives an empty result; repeated rows are separate documents.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timegrid.llm.common import save, word_count

BLOCK_WORDS = 32
SHARD_DOCS = 1024
ROUNDS = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), rounds: int = ROUNDS) -> DataFrame:
    """A row per source with its size -> sid (rank by code point, null last), target: the shares of all words.

    Sharing the excess of capped sources again and again ends where min(cap, level * weight) sums to all words.
    Sorted by cap / weight, a source is capped if the level without it and what follows would still pass its cap.
    """
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    named = sources.withColumn("sid", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    named = named.withColumn("weight", w.cast("double")).withColumn("cap", (F.col("source_size") * rounds).cast("double"))
    before = one.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    marked = named.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    last = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("level")))).over(one)
    target = F.when(F.col("capped") | last.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), last["level"] * F.col("weight")))
    return marked.select("source", "sid", "source_size", "n_docs", target.alias("target"))


def apportion(df: DataFrame, group: list[str], key: str, votes: Column, seats: Column) -> DataFrame:
    """Sainte-Laguë: adds `quota`, the seats of each row; in each group the highest quotients votes / (2k + 1) win.

    Only seats near the proportional share are ranked: rounding the shares misses the seats by half a seat a row at
    most, so n more or fewer seats on the divisor's scale always settle it, of which a row gets its share and one.
    That makes about four quotients a row, however many seats there are.
    """
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    t = df.withColumn("_votes", votes.cast("double")).withColumn("_seats", seats.cast("long"))
    total = F.sum("_votes").over(own)
    share = F.when(total > 0, F.col("_votes") / total).otherwise(F.lit(0.0))
    t = t.withColumn("_share", share).withColumn("_span", (F.ceil(F.col("_share") * F.count(F.lit(1)).over(own)) + 2).cast("long"))
    t = t.withColumn("_base", F.floor(F.col("_share") * F.col("_seats")).cast("long"))
    t = t.withColumn("_low", F.greatest(F.lit(0), F.col("_base") - F.col("_span")))
    t = t.withColumn("_left", F.col("_seats") - F.sum("_low").over(own))
    ask = t.select(*group, key, "_votes", "_left", F.explode(F.sequence(F.col("_low"), F.col("_base") + F.col("_span"))).alias("_k"))
    ranked = ask.withColumn("_rank", F.row_number().over(own.orderBy((F.col("_votes") / (2 * F.col("_k") + 1)).desc(), key, "_k")))
    won = ranked.where((F.col("_rank") <= F.col("_left")) & (F.col("_votes") > 0)).groupBy(*group, key).agg(F.count(F.lit(1)).alias("_won"))
    out = t.join(won, [*group, key], "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
    return out.drop("_votes", "_seats", "_share", "_span", "_base", "_low", "_left", "_won")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK_WORDS, rounds: int = ROUNDS, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with size, source_size, target and taken, the words that the mix takes of it (repeats count).

    carry: expressions over docs whose values go along. Nothing but sizes, ids and these is shuffled.
    """
    sizes = save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *(F.expr(c) for c in carry)), "sizes")
    kept = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    src = targets(per_source, weights, rounds)
    everything = F.sum("target").over(Window.partitionBy(F.lit(0)))
    src = apportion(src, [], "sid", F.col("target"), F.round(everything / block))
    src = save(src.withColumnRenamed("quota", "source_quota").withColumn("shards", F.ceil(F.col("n_docs") / SHARD_DOCS).cast("long")), "sources")

    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = sizes.alias("d").join(src.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    placed = placed.select("doc_id", "size", *kept, "sid", "source_size", "target", "source_quota", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.col("shards")).alias("shard"))
    shards = placed.groupBy("sid", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = apportion(shards, ["sid"], "shard", F.col("shard_size"), F.col("source_quota")).select("sid", "shard", "quota")

    run = Window.partitionBy("sid", "shard").orderBy(order, "doc_id", "size", *kept).rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("at", F.coalesce(F.sum("size").over(run), F.lit(0))).withColumn("ring", F.sum("size").over(Window.partitionBy("sid", "shard")))
    laid = laid.join(shards, ["sid", "shard"])
    words = F.least(F.col("quota") * block, F.col("ring") * rounds)
    start = F.pmod(F.pmod(F.xxhash64(F.lit(seed + 2), F.col("sid"), F.col("shard")), F.ceil(F.col("ring") / block)) * block, F.col("ring"))
    laid = laid.withColumn("words", words).withColumn("start", F.when(F.col("ring") > 0, start).otherwise(F.lit(0)))
    full = F.when(F.col("ring") > 0, F.floor(F.col("words") / F.col("ring"))).otherwise(F.lit(0)).cast("long")
    laid = laid.withColumn("full", full).withColumn("rest", F.col("words") - F.col("full") * F.col("ring"))
    end = F.col("start") + F.col("rest")

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), b) - F.greatest(F.col("at"), a))

    part = overlap(F.col("start"), F.least(end, F.col("ring"))) + overlap(F.lit(0), end - F.col("ring"))
    taken = (F.col("full") * F.col("size") + part).cast("long")
    return laid.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *kept)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: each comes round(taken / size) times, whole; the columns stay.

    Whole documents only, so a shard differs from its quota by less than its two boundary documents. Rows that agree
    in all of doc_id, source and text share one decision, that of the first of them.
    """
    key = "xxhash64(doc_id, source, text)"
    done = mix(docs, carry=(f"{key} AS _key",), **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    times = done.groupBy("_key").agg(F.min_by(times, F.col("taken")).alias("_times")).where("_times > 0")
    # the documents' own columns go along in one, so none of their names can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.expr(key).alias("_key")).join(times, "_key")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")
