"""Merkle manifest of a table: a tree of digests for each group, one root over all, and a proof for every row.

A leaf is the digest of a row's fields. In a group, leaves ascend by key and every two neighbours become their
parent's digest, until one is left, the group's subroot; subroots are joined the same way into the root. Who holds the
root can check a row by its leaf and its proof, the siblings on the way up.

Proofs come by pointer jumping. Every node starts with one sibling and a pointer to its parent. A round joins the
nodes' pointers with the nodes themselves, appends the ancestor's segment to the own one and takes over its pointer, so
the distance doubles. Only nodes that later rounds ask for go on: those whose level is a multiple of the distance. So
leaves are the bulk of each round, and the side that they meet shrinks: n / 2, n / 4, n / 16, ... rows.

Scale: places in the order come from ranges of it that are sorted apart and counted, not from a window. 256 neighbours
at a time become a subtree. A round's smaller side goes to all executors if its size, known from the counts, is at most
BROADCAST_BYTES; larger ones have so many keys that a join by key spreads evenly. Every round is a saved table.
To the driver come the number of rows of each partition and level, the number of groups and the root.

Defined cases: any field may be null; rows without a key come first; of equal keys the smaller leaf digest comes first,
and equal rows have equal leaves and stay apart, each with its own proof; an empty table has no root and no rows; a
table of one row has its leaf as root and an empty proof; columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import remove, save

#: Fields of a document's leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a tree that one grouping builds: 2 ** STEP neighbours are a group.
STEP = 8
#: Bits of a node's id below its level.
PLACE = 56
#: A sibling in a proof: one byte for its side, then its digest.
ALONE, LEFT, RIGHT = 0, 1, 2
SIBLING = 33
BROADCAST_BYTES = 8 << 20


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of a row's fields, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _bytes(*values: int) -> Column:
    return F.lit(bytearray(values))


def indexed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `part`, the range of the order that a row lies in, and `index`, its place in the whole order from 0."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = save(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [0]
    for i in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(i, 0))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn("part", part.cast("int")).withColumn("index", F.element_at(F.lit(starts).cast("array<bigint>"), F.col("part") + 1) + within).drop("_at")
    out._saved_in = placed._saved_in
    return out


def _at_level(n: Column, level: int) -> Column:
    """How many nodes a tree of n leaves has at a level."""
    return F.shiftright(n + ((1 << level) - 1), level)


def _parents(nodes: Column) -> Column:
    def parent(i: Column) -> Column:
        return F.unhex(F.sha2(F.concat(_hex(F.get(nodes, i)), F.coalesce(_hex(F.get(nodes, i + 1)), F.lit(""))), 256))

    return F.transform(F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(2)), parent)


def _with_siblings(nodes: Column, level: int, step: int, payload: Column) -> Column:
    """Of each node: its level and place, and its sibling with the side."""

    def one(digest: Column, i: Column) -> Column:
        after = F.get(nodes, i + 1)
        sibling = F.when(i % 2 == 1, F.concat(_bytes(LEFT), F.get(nodes, i - 1))).when(after.isNotNull(), F.concat(_bytes(RIGHT), after)).otherwise(_bytes(ALONE, *[0] * 32))
        own = F.get(payload, i) if level + step == 0 else F.get(F.slice(payload, 1, 0), F.lit(0))
        return F.struct(F.lit("node").alias("kind"), F.lit(level + step).alias("level"), (F.shiftleft(F.col("block"), STEP - step) + i).alias("pos"), sibling.alias("digest"), own.alias("payload"))

    return F.transform(nodes, one)


def forest(leaves: DataFrame, height: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The trees over leaves (start, n, g, pos, digest, payload), pos counting from 0 to n - 1 in each tree (start).

    Gives tables of the nodes below the tops, with level, pos and sibling, and of the tops, with their digest. Nodes at
    level 0, and the top of a tree of one leaf, keep the payload.
    """
    level, rows, tables = 0, leaves, []
    while True:
        member = F.array_sort(F.collect_list(F.struct("pos", "digest", "payload")))  # 2 ** STEP at most
        built = rows.groupBy("start", "n", "g", F.shiftright("pos", STEP).alias("block")).agg(member.alias("m"))
        built = built.select("start", "n", "g", "block", F.transform("m", lambda x: x["digest"]).alias("a0"), F.transform("m", lambda x: x["payload"]).alias("payloads"))
        for s in range(STEP):
            built = built.withColumn(f"a{s + 1}", F.when(_at_level(F.col("n"), level + s) > 1, _parents(F.col(f"a{s}"))))
        done = _at_level(F.col("n"), level + STEP) <= 1
        top = F.coalesce(*(F.get(F.col(f"a{s}"), F.lit(0)) for s in range(STEP, -1, -1)))
        first = F.get("payloads", F.lit(0))
        none = F.get(F.slice("payloads", 1, 0), F.lit(0))
        tops = F.array(F.struct(F.when(done, "top").otherwise("inner").alias("kind"), F.lit(level + STEP).alias("level"), F.col("block").alias("pos"), top.alias("digest"), F.when(F.col("n") == 1, first).otherwise(none).alias("payload")))
        below = [F.when(F.col(f"a{s + 1}").isNotNull(), _with_siblings(F.col(f"a{s}"), level, s, F.col("payloads"))) for s in range(STEP)]
        every = F.filter(F.concat(tops, *(F.coalesce(b, F.slice(tops, 1, 0)) for b in below)), lambda x: x.isNotNull())
        table = save(built.select("start", "n", "g", F.explode(every).alias("x")).select("start", "n", "g", "x.*"), name)
        tables.append(table)
        level += STEP
        if level >= height:
            break
        rows = table.where("kind = 'inner'").select("start", "n", "g", "pos", "digest", "payload")
    return [t.where("kind = 'node'") for t in tables], [t.where("kind = 'top'") for t in tables]


def _id(level: Column, place: Column) -> Column:
    return F.shiftleft(level.cast("long"), PLACE).bitwiseOR(place.cast("long"))


def _by(value: Column, bits: Column) -> Column:
    """value * 2 ** bits; the shift functions of the API take only numbers."""
    return F.call_function("shiftleft", value.cast("long"), bits.cast("int"))


@dataclass
class Manifest:
    """root: hex, None for an empty table. groups: group key, n, subroot. proofs: a row for each of the table's, as
    `row` (the kept columns), leaf, subroot and proof, of which `siblings` and `folded` read."""

    root: str | None
    groups: DataFrame
    proofs: DataFrame


def _jumped(table: DataFrame, counts: dict[int, int], distance: int) -> DataFrame:
    """One round: nodes at multiples of twice the distance take over segment and pointer of the ancestor that they point to."""
    level = F.shiftright("id", PLACE) % (2 * distance)
    right = table.where(level == distance).select(F.col("id").alias("_up"), F.col("up").alias("_next"), F.col("segment").alias("_segment"), F.col("subroot").alias("_subroot"))
    rows = sum(n for k, n in counts.items() if k % (2 * distance) == distance)
    if rows * (SIBLING * distance + 120) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    met = table.where(level == 0).join(right, F.col("up") == F.col("_up"), "left")
    return met.select("id", F.when(F.col("_up").isNull(), F.col("up")).otherwise(F.col("_next")).alias("up"), F.concat("segment", F.coalesce("_segment", _bytes())).alias("segment"), F.coalesce("subroot", "_subroot").alias("subroot"), "payload")


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of rows. keep: columns that the proofs carry along, by name."""
    spark = rows.sparkSession
    kept = F.struct(*(c.alias(k) for k, c in (keep or {key: F.col(key)}).items()))
    # a group's key as a string that sorts as the group does, null first, and is never null
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    own = rows.select(name.alias("name"), F.col(key).alias("key"), leaf_digest([F.col(f) for f in fields]).alias("digest"), kept.alias("row"))
    leaves = save(own.withColumn("copy", F.monotonically_increasing_id()), "leaves")
    placed = indexed(leaves, ["name", "key", "digest", "copy"], "ordered")
    # a row for each range and group: hot groups are met range by range
    spans = save(placed.groupBy("part", "name").agg(F.min("index").alias("start"), F.count(F.lit(1)).alias("n")), "spans")
    names = spans.groupBy("name").agg(F.min("start").alias("start"), F.sum("n").alias("n"))
    groups = indexed(names, ["name"], "groups").select("name", "start", "n", F.col("index").alias("g"))
    most, total = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    shown = F.when(F.col("name") != "-", F.expr("substring(name, 2)"))
    if not total:
        empty = groups.select(shown.alias(group), "n", F.lit("").alias("subroot"))
        return Manifest(None, empty, leaves.select("row", "digest", F.col("digest").alias("subroot"), F.col("digest").alias("proof")).withColumnRenamed("digest", "leaf"))
    height, rise = max(1, (most - 1).bit_length()), (total - 1).bit_length()
    keyed = placed.join(spans.select("part", "name").join(groups, "name"), ["part", "name"])
    payload = F.struct("row", F.col("digest").alias("leaf"))
    nodes, tops = forest(keyed.select("start", "n", "g", (F.col("index") - F.col("start")).alias("pos"), "digest", payload.alias("payload")), height, "trees")
    top = reduce(DataFrame.unionByName, tops)
    upper, roots = forest(top.select(F.lit(0).cast("long").alias("start"), F.lit(total).cast("long").alias("n"), F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), "digest", F.struct("start", "digest").alias("payload")), rise, "upper")
    root = reduce(DataFrame.unionByName, roots).select(_hex(F.col("digest"))).first()[0]

    level, pos, start = F.col("level"), F.col("pos"), F.col("start")
    nothing = F.lit(None).cast("binary")
    into = F.when(level + 1 == height, _id(level + 1, F.col("g")))
    lower = [t.select(_id(level, start + _by(pos, level)).alias("id"), into.otherwise(_id(level + 1, start + _by(F.shiftright(pos, 1), level + 1))).alias("up"), F.col("digest").alias("segment"), nothing.alias("subroot"), "payload") for t in nodes]
    # trees lower than the highest go on without siblings
    low = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    levels = F.when(low < height, F.sequence(low, F.lit(height - 1))).otherwise(F.array().cast("array<int>"))
    passed = top.withColumn("level", F.explode(levels)).select(_id(level, start).alias("id"), into.otherwise(_id(level + 1, start)).alias("up"), _bytes().alias("segment"), nothing.alias("subroot"), F.when(level == 0, F.col("payload")).alias("payload"))
    shape = "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in top.schema["payload"].dataType.fields) + ">"
    above = [t.select(_id(level + height, pos).alias("id"), _id(level + height + 1, F.shiftright(pos, 1)).alias("up"), F.col("digest").alias("segment"), F.when(level == 0, F.col("payload.digest")).alias("subroot"), F.lit(None).cast(shape).alias("payload")) for t in upper]
    own_root = F.unhex(F.lit(root)) if rise == 0 else nothing
    last = spark.range(1).select(_id(F.lit(height + rise), F.lit(0)).alias("id"), F.lit(None).cast("long").alias("up"), _bytes().alias("segment"), own_root.alias("subroot"), F.lit(None).cast(shape).alias("payload"))
    table = reduce(DataFrame.unionByName, [*lower, passed, *above, last])

    counts = {r["level"]: r["n"] for r in table.groupBy(F.shiftright("id", PLACE).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for spent in (leaves, placed):
        remove(spark, spent._saved_in)
    distance = 1
    while distance <= height + rise:
        jumped = _jumped(table, counts, distance)
        distance *= 2
        counts = {k: n for k, n in counts.items() if k % distance == 0}
        if distance <= height + rise:
            saved = save(jumped, f"jumps{distance}")
            if distance > 2:
                remove(spark, table._saved_in)
            table = saved
        else:
            table = jumped
    proofs = table.where(F.shiftright("id", PLACE) == 0).select("payload.row", "payload.leaf", "subroot", F.col("segment").alias("proof"))
    return Manifest(root, top.join(groups.select("start", "name"), "start").select(shown.alias(group), "n", _hex(F.col("digest")).alias("subroot")), proofs)


def _entries(proof: Column) -> Column:
    return F.when(F.length(proof) > 0, F.sequence(F.lit(0), (F.length(proof) / SIBLING).cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _entry(proof: Column, i: Column) -> tuple[Column, Column]:
    side = F.call_function("substring", proof, i * SIBLING + 1, F.lit(1))
    return side, _hex(F.call_function("substring", proof, i * SIBLING + 2, F.lit(SIBLING - 1)))


def siblings(proof: Column) -> Column:
    """The siblings' digests in hex, from the leaf to the root."""
    there = F.filter(_entries(proof), lambda i: _entry(proof, i)[0] != _bytes(ALONE))
    return F.transform(there, lambda i: _entry(proof, i)[1])


def folded(leaf: Column, proof: Column) -> Column:
    """The root, in hex, that a leaf (32 bytes) and a proof lead to."""

    def up(digest: Column, i: Column) -> Column:
        side, sibling = _entry(proof, i)
        return F.sha2(F.when(side == _bytes(LEFT), F.concat(sibling, digest)).when(side == _bytes(RIGHT), F.concat(digest, sibling)).otherwise(digest), 256)

    return F.aggregate(_entries(proof), _hex(leaf), up)


def tamper_check(docs: DataFrame) -> DataFrame:
    """Every document's leaf and proof, and whether the proof holds after some rows have been changed.

    Changed are those whose unsigned crc32 of the decimal doc_id is a multiple of 7: their n_chars grows by one.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    changed = leaf_digest([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    made = manifest(docs, keep={"doc_id": F.col("doc_id"), "changed": F.when(hit, changed)})
    proof = F.col("proof")
    return made.proofs.select(
        F.col("row.doc_id").alias("doc_id"), _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.lit(made.root).cast("string").alias("root"),
        F.sha2(F.concat_ws("", siblings(proof)), 256).alias("proof_sha256"), folded(F.coalesce("row.changed", "leaf"), proof).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
