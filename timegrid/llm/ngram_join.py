"""Similarity join of documents by the Jaccard measure of their word n-grams, and its classes.

A document's set is its distinct word n-grams. With similarity at least t, two sets that are ordered by one global
order of n-grams share a member among the first size - ceil(t * size) + 1 of each: their prefixes. That holds in every
global order, so candidates must share a prefix member in several orders.

Moreover the first common member has at least as many members after it, in both sets, as they must have in common.

The first order puts rare n-grams first: a sketch of fixed size counts all n-grams of all documents by hash, and the
order sorts by the count's class, then by a hash of its own. Passages and lines that many documents share so come last,
and documents that merely share them don't meet. The further orders are by hashes alone, and there longer prefixes are
compared, cut at a hash value that is the same for all sets: of the a' members of a prefix all but a - least have to be
in the other set, and so in its prefix.

1. Each text is profiled: size and digest of its set, and its prefixes in the further orders. Texts with equal sets are
   one from here on.
2. Prefixes in the first order are dealt out by member; only members with two sets or more stay.
3. Every member's sets are compared with one of them, chosen by hash. Pairs must pass the sizes, the place of the member,
   and the prefixes of all other orders. Only of the pairs left texts are read again and their sets intersected exactly.
   The links found make classes.
4. What could still join two classes is compared too: in each member's list, all pairs of sets of different classes.
   So no link between classes is missed, and large groups of similar documents never emit all their pairs.

Defined cases: null, empty and blank texts have empty sets and are classes of their own; texts with fewer than n words
have their whole sequence as the one member; repeated rows give a row each, and so does a doc_id that occurs with unlike
texts; rows without doc_id link like others, and give a class its id only if it has no other (null then); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import hashes_of, mixed, release, save, slices, words_of
from timegrid.llm.components import components

ORDERS = 3
#: The part of all hash values that the prefixes of the further orders cover.
COVER = 3 / 16
#: So many tasks' sketches are summed by one task.
MERGE = 256
SKETCH_BITS = 23
CHUNK = 1 << 16
POSTING = ["member", "digest", "size", "place"]


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    flat, counts = words_of(texts)
    words = hashes_of(flat)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n if len(grams) else 0):
        grams += mixed(words[j : j + len(grams)], j)
    grams = mixed(grams, n)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1]))
        elif c:
            # fewer words than n: the whole sequence, marked by its length
            out.append(mixed(np.array([sum(int(x) for x in mixed(words[at : at + c], 7)) & 0xFFFFFFFFFFFFFFFF], np.uint64) + _sequence(words[at : at + c]), 100 + c))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def _sequence(words: np.ndarray) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(words.tobytes()))


def digest(members: np.ndarray) -> int:
    """64 bits that stand for a set, as a signed long."""
    return int(np.array([xxhash.xxh3_64_intdigest(members.tobytes())], np.uint64).view(np.int64)[0])


def prefix_length(size: int, percent: int) -> int:
    """size - ceil(t * size) + 1 for t in per cent."""
    return size - (percent * size + 99) // 100 + 1


def prefix(members: np.ndarray, classes: np.ndarray, percent: int, order: int) -> np.ndarray:
    """The first members in one of the orders, in that order."""
    p = prefix_length(len(members), percent)
    rank = (classes[members & np.uint64(len(classes) - 1)].astype(np.uint64) << np.uint64(56)) | (mixed(members, 50 + order) >> np.uint64(8))
    first = np.argpartition(rank, p - 1)[:p] if p < len(members) else np.arange(len(members))
    return members[first[np.argsort(rank[first])]]


PROFILE = "doc_id long, name long, size long, digest long, prefixes array<binary>, chunk int, task int, counts binary"


def named(text: Column) -> Column:
    """64 bits by which a text is found again."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def further_prefixes(members: np.ndarray, orders: int) -> list[bytes]:
    """For each order after the first the sorted 32-bit hashes of the set's members that it puts below the cut."""
    out = []
    for k in range(1, orders):
        h = mixed(members, 90 + k)
        out.append(np.unique((h[h < np.uint64(int(COVER * 2**64))] >> np.uint64(30)).astype("<u4")).tobytes())
    return out


def _sparse(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return zlib.compress(at.astype("<u2").tobytes() + counts[at].astype("<u8").tobytes(), 1)


def _summed(rows: list[bytes]) -> np.ndarray:
    total = np.zeros(CHUNK, np.int64)
    for data in rows:
        raw = zlib.decompress(data)
        k = len(raw) // 10
        total[np.frombuffer(raw[: 2 * k], "<u2")] += np.frombuffer(raw[2 * k :], "<u8").astype(np.int64)
    return total


def profiles(docs: DataFrame, n: int, orders: int = ORDERS) -> DataFrame:
    """A row per document (doc_id, name, size, digest, prefixes), and rows of each task's part of the sketch (chunk, task, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = [f.split(" ")[0] for f in PROFILE.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), n)
                np.add.at(sketch, np.concatenate([np.empty(0, np.uint64), *sets]) & np.uint64(len(sketch) - 1), 1)
                none = [None] * len(sets)
                columns = (part.column("doc_id"), part.column("name"), [len(s) for s in sets], [digest(s) for s in sets], [further_prefixes(s, orders) for s in sets], none, none, none)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        for chunk in range(len(sketch) // CHUNK):
            counts = sketch[chunk * CHUNK : (chunk + 1) * CHUNK]
            if counts.any():
                row = (None, None, None, None, None, chunk, TaskContext.get().partitionId(), _sparse(counts))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    return save(docs.select("doc_id", named(F.col("text")).alias("name"), "text").mapInArrow(run, PROFILE), "profiles")


def frequency_classes(rows: DataFrame) -> np.ndarray:
    """Class by sketch cell: 0 for what looks rare, then a class for each factor of the square root of two.

    The sketch has a fixed size, so this array has too. Its cells' mean is the noise that all n-grams share. Sketches
    are summed in two steps, so that no task holds those of all tasks.
    """

    def some(table: pa.Table) -> pa.Table:
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([_sparse(_summed(table.column("counts").to_pylist()))])})

    def run(table: pa.Table) -> pa.Table:
        total = _summed(table.column("counts").to_pylist())
        classes = np.clip(np.floor(2 * np.log2(np.maximum(total, 1) / (2 * mean + 8))) + 1, 0, 255).astype(np.uint8)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "classes": pa.array([zlib.compress(classes.tobytes(), 1)])})

    mean = float(rows.agg(F.sum("size")).first()[0] or 0) / (1 << SKETCH_BITS)
    parts = rows.where("chunk IS NOT NULL").select("chunk", F.floor(F.col("task") / MERGE).alias("part"), "counts")
    parts = parts.groupBy("chunk", "part").applyInArrow(some, "chunk int, counts binary")
    classes = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in parts.groupBy("chunk").applyInArrow(run, "chunk int, classes binary").collect():
        classes[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["classes"]), np.uint8)
    return classes


def postings(docs: DataFrame, n: int, percent: int, classes) -> DataFrame:
    """(member, digest, size, place) of the prefixes in the first order; a task gives a set once. classes: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                members, ids, sizes = [], [], []
                for s in shingle_sets(part.column("text"), n):
                    if len(s) and (d := digest(s)) not in seen:
                        seen.add(d)
                        members.append(prefix(s, classes.value, percent, 0))
                        ids.append(d)
                        sizes.append(len(s))
                lengths = [len(m) for m in members]
                columns = [np.concatenate([np.empty(0, np.uint64), *members]).view(np.int64), np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths)]
                columns.append(np.concatenate([np.empty(0, np.int32), *(np.arange(n_, dtype=np.int32) for n_ in lengths)]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], POSTING)

    return docs.select("doc_id", "text").mapInArrow(run, "member long, digest long, size int, place int")


def shared(rows: DataFrame) -> DataFrame:
    """The postings whose member has two sets or more, each once: a scan of the sorted rows that holds one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_run = None, False  # the last row so far, and whether its run has two sets already
        kinds = (np.int64, np.int64, np.int32, np.int32)
        for batch in batches:
            rows = [np.asarray(c) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate([[h], c]) for h, c in zip(held, rows, strict=True)]
            m, d = rows[:2]
            if not len(m):
                continue
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
            rows = [c[new] for c in rows]
            m = rows[0]
            like_before, like_after = np.zeros(len(m), bool), np.zeros(len(m), bool)
            like_before[1:] = like_after[:-1] = m[1:] == m[:-1]
            like_before[0] = open_run
            keep = (like_before | like_after)[:-1]
            held, open_run = [c[-1] for c in rows], bool(like_before[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep].astype(t)) for c, t in zip(rows, kinds, strict=True)], POSTING)
        if held is not None and open_run:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([h], t)) for h, t in zip(held, kinds, strict=True)], POSTING)

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return save(rows.repartition(parts, "member").sortWithinPartitions("member", "digest").mapInArrow(run, "member long, digest long, size int, place int"), "shared")


def _may_link(percent: int):
    """Whether two sets may link that share a member at these places of their orders.

    Linked sets have least = ceil(t (a + b) / (1 + t)) members in common, at or after their first common one in either
    order; so for that member neither set has fewer than that many left. One of the smaller sets of a group whose rare
    members come first meets no other that way.
    """
    a, b = F.col("size").cast("long"), F.col("pivot_size").cast("long")
    least = F.floor((percent * (a + b) + (99 + percent)) / (100 + percent))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (a - F.col("place") >= least) & (b - F.col("pivot_place") >= least)


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b of digests) that share enough of their prefixes in each further order. sets: digest, size, prefixes.

    Pairs that merely share a passage go here, for the price of prefixes instead of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("size_a", "size_b", "prefixes_a", "prefixes_b")]
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b, xs, ys) in enumerate(zip(*columns, strict=True)):
                least = (percent * (a + b) + 99 + percent) // (100 + percent)
                keep[i] = all(_share(x, y, a - least, b - least) for x, y in zip(xs, ys, strict=True))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def side(k: str) -> DataFrame:
        return sets.select(F.col("digest").alias(k), F.col("size").alias(f"size_{k}"), F.col("prefixes").alias(f"prefixes_{k}"))

    return save(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long"), "likely")


def _share(x: bytes, y: bytes, extra_a: int, extra_b: int) -> bool:
    """Whether two prefixes have all in common but so many members of either. Hashes of 32 bits: equal ones may be unlike, never the reverse."""
    u, v = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    both = len(np.intersect1d(u, v, assume_unique=True))
    # members whose 32-bit hashes agree are one in a prefix; that lowers both sides alike or favours the pair
    return both >= len(u) - extra_a and both >= len(v) - extra_b


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b of digests) that link, by their whole sets. sets: digest, name. Only the pairs' texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray | None] = {}

        def entry(d: int, text: str) -> np.ndarray | None:
            if known.get(d) is None:  # not there, or so far only another text of the same name
                if len(known) >= 64:
                    known.pop(next(iter(known)))
                s = shingle_sets(pa.array([text], pa.string()), n)[0]
                known[d] = s if len(s) and digest(s) == d else None
            return known[d]

        for batch in batches:
            a_out, b_out = [], []
            for part in slices(batch, "text_b"):
                for a, b, ta, tb in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                    sa, sb = entry(a, ta), entry(b, tb)
                    if sa is None or sb is None:
                        continue
                    both = len(np.intersect1d(sa, sb, assume_unique=True))
                    if 100 * both >= percent * (len(sa) + len(sb) - both):
                        a_out.append(a)
                        b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(sets.select("digest", "name"), "digest")
    # a name's text: the same text may occur many times, and one of them is enough
    texts = docs.select(named(F.col("text")).alias("name"), "text").join(wanted.select("name").distinct(), "name", "left_semi")
    texts = texts.groupBy("name").agg(F.min("text").alias("text"), F.max("text").alias("other"))
    texts = texts.select("name", F.explode(F.array_distinct(F.array("text", "other"))).alias("text"))
    texts = save(wanted.join(texts, "name").select("digest", "text"), "texts")
    with_a = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
    links = save(with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")
    release(texts)
    return links


def classes_of(docs: DataFrame, n: int = 4, percent: int = 85, orders: int = ORDERS) -> DataFrame:
    """A row per document: doc_id, name (of its text), size (of its set), root (64 bits that stand for its class; null: empty set)."""
    spark = docs.sparkSession
    profiled = profiles(docs, n, orders)
    classes = spark.sparkContext.broadcast(frequency_classes(profiled))
    rows = profiled.where("chunk IS NULL").select("doc_id", "name", "size", "digest")
    lists = shared(postings(docs, n, percent, classes))

    wanted = lists.select("digest").distinct()
    sets = profiled.where("size > 0").select("digest", "name", "size", "prefixes").join(wanted, "digest")
    # of equal sets the first name and any prefixes (they are equal too) stand for all
    sets = save(sets.groupBy("digest").agg(F.min("name").alias("name"), F.first("size").alias("size"), F.first("prefixes").alias("prefixes")), "sets")

    a, b = F.least("digest", "pivot"), F.greatest("digest", "pivot")
    pivot = lists.groupBy("member").agg(F.min_by(F.struct("digest", "size", "place"), F.struct("place", F.xxhash64("member", "digest"))).alias("p"))
    star = lists.join(pivot, "member").select("digest", "size", "place", F.col("p.digest").alias("pivot"), F.col("p.size").alias("pivot_size"), F.col("p.place").alias("pivot_place"))
    star = save(star.where((F.col("digest") != F.col("pivot")) & _may_link(percent)).select(a.alias("a"), b.alias("b")).distinct(), "star")
    links = verified(likely(star, sets, percent), sets, docs, n, percent)
    roots = components(links)

    classed = lists.join(roots.withColumnRenamed("v", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    classed = save(classed, "classed")
    release(lists)
    by_class = classed.groupBy("member", "root").agg(F.count(F.lit(1)).alias("c"))
    major = by_class.groupBy("member").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    minor = classed.join(major.select("member", "major"), "member").where("root <> major").drop("major")
    x = classed.select("member", F.col("digest").alias("pivot"), F.col("size").alias("pivot_size"), F.col("place").alias("pivot_place"), F.col("root").alias("pivot_root"))
    cross = minor.join(x, "member").where((F.col("root") != F.col("pivot_root")) & _may_link(percent))
    cross = save(cross.select(a.alias("a"), b.alias("b")).distinct().join(star, ["a", "b"], "left_anti"), "cross")
    more = verified(likely(cross, sets, percent), sets, docs, n, percent)
    release(star, classed, cross)
    roots = components(links.unionByName(more))
    return rows.join(roots.withColumnRenamed("v", "digest"), "digest", "left").select("doc_id", "name", "size", F.when(F.col("size") > 0, F.coalesce("root", "digest")).alias("root"))


def linked(docs: DataFrame, n: int = 4, percent: int = 85, orders: int = ORDERS) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    rows = save(classes_of(docs, n, percent, orders), "classes")
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "root", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class, with all its columns: that of the smallest (doc_id, hash of the text), null ids last.

    Rows are told apart by doc_id and text, so a doc_id with unlike texts loses only what has a like one elsewhere. Of
    rows that agree in both one stays. Documents with empty sets all stay.
    """
    rows = save(classes_of(docs, n, percent), "classes").where("root IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("name"))
    best = rows.groupBy("root").agg(F.min(order).alias("best"))
    counted = rows.groupBy("root", "doc_id", "name").agg(F.count(F.lit(1)).alias("copies")).join(best, "root").withColumn("wins", order == F.col("best"))
    marks = save(counted.where(~F.col("wins") | (F.col("copies") > 1)).select(F.col("doc_id").alias("i"), F.col("name").alias("k"), "wins"), "marks")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), named(F.col("text")).alias("name"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("name") == F.col("k"))
    kept = own.join(marks, same, "left_anti")
    again = own.join(marks.where("wins"), same, "left_semi").groupBy("id", "name").agg(F.first("row").alias("row"))
    return kept.select("row.*").unionByName(again.select("row.*"))
