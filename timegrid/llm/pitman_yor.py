"""A hierarchical Pitman-Yor word model, for perplexity.

Two levels of restaurants. A context restaurant holds the words that followed one word; all context restaurants share
one parent, the restaurant of single words, whose own base is uniform over the vocabulary and one unknown word. A
customer of a context restaurant that opens a table is a customer of the parent.

Seating is sampled in sweeps of blocked Gibbs. A sweep reseats the dishes of all contexts given the parent and the
table totals of the sweep before, sums the tables by word, and reseats the parent's dishes given these. The predictive
probabilities of the sweeps after the first ones are averaged.

How it is dealt: every pair (context, word) of the training texts is counted, none is dropped. Tasks sum the pairs of a
run of texts and send them, packed, to shards by the context's hash, so that a restaurant's customers, tables and
dishes lie in one task. A context that holds more than a shard's part of the tokens is dealt over several shards by the
word's hash; its totals, a row each, go back to its shards. The words lie in buckets by their hash. A bucket and a shard
exchange packed arrays, a row for each two of them: the bucket tells the parent's customers and tables of the words that
the shard holds, in the order of the words' places, and the shard gives back its tables by word in that order, so that no
row for a word is joined. Scoring sends the distinct pairs of texts to the same shards. Shards have a bounded number of
tokens, and their number grows with the texts; so does that of the buckets.

Broadcast are shortcuts only, which save rows and change no result: the most frequent words and pairs, in fixed number.

All draws come from hashes of the dish, the sweep and the step, and totals are whole numbers, so the partitioning of the
texts changes no seating; scores agree but for the order of sums.

Words are runs between ASCII blanks with A-Z lowered; each text ends with one end token. A word stands as its 64-bit
hash. Defined cases: null, empty and blank texts are the end token alone; repeated rows are scored each, and counted
each in training; with no training rows the vocabulary is empty, and every token has the uniform probability 1; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import coded_words, mixed, release, save, slices, trim, trimmed

SWEEPS = 4
BURN_IN = 2
#: Dishes of up to so many customers are reseated exactly.
EXACT = 64
#: Buckets of words: one for so many shards, but at least LEAST_BUCKETS, or the shards' number.
BUCKET_SHARDS = 4
LEAST_BUCKETS = 24
#: Bytes of text for each shard, and tokens that a task sums before it sends them.
SHARD_BYTES = 4 << 20
RUN_TOKENS = 800_000
ASK_TOKENS = 500_000
#: Bytes of text that tell which contexts to deal over several shards, and which words, at most CODES, get short names.
#: Both decide places and sizes of what is sent, not results.
PROBE_BYTES = 16 << 20
CODES = 200_000
#: Bytes from which on packed values are compressed.
LEAST_FRAME = 256
#: Words whose values are broadcast to be looked up where texts are.
NEAR_WORDS = 200_000
#: Pairs whose probabilities are broadcast to be looked up where texts are.
NEAR_PAIRS = 250_000
END, START, TOP = np.uint64(0xD851F42D4C957F2D), np.uint64(0x94057B7EF767814F), np.uint64(1 << 63)


def _with_ends(texts: pa.Array, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens, the end token after each text, and tokens per text.

    A word's name is its hash with the top bit set, or for the words in `coded` (such names, sorted) its place there.
    """
    hashes, which, counts = coded_words(texts)
    names = hashes | TOP
    at, short = _find(coded, names)
    names = np.where(short, at.astype(np.uint64), names)
    return np.insert(names[which], np.cumsum(counts), END), counts + 1


def _contexts(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(counts) - counts] = START
    return before


def _named(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits that stand for a pair."""
    return mixed(context, 1) + word


def _find(sorted_: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked value in a sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_, asked), len(sorted_) - 1)
    return at, sorted_[at] == asked


def _argsort(keys: np.ndarray) -> np.ndarray:
    """np.argsort(keys, kind="stable") for 64-bit hashes: one sort of their upper bits with the places below these.

    Where upper bits of unequal keys agree, which is rare among hashes, the usual way is taken.
    """
    keys = keys.view(np.uint64)
    bits = np.uint64(max(1, len(keys).bit_length()))
    both = (keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    del both
    there = keys[order]
    return order if (there[1:] >= there[:-1]).all() else np.argsort(keys, kind="stable")


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of 64-bit hashes, starts of the runs of equal ones in it, and the run of each."""
    order = _argsort(keys)
    starts, lengths = _runs(keys[order])
    run = np.empty(len(keys), np.int64)
    run[order] = np.repeat(np.arange(len(starts)), lengths)
    return order, starts, run


@functools.cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _bytes(values: np.ndarray, kind: str) -> bytes:
    """The values' bytes, first all lowest ones, then the next and so on, which compress well that way.

    A leading byte tells whether the rest is a zstd frame; short ones stay as they are.
    """
    values = np.ascontiguousarray(values.astype(kind, copy=False))
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return b"\1" + _codec()[0].compress(planes) if len(planes) >= LEAST_FRAME else b"\0" + planes


def _array(data: bytes | None, kind: str) -> np.ndarray:
    planes = data[1:] if data else b""
    if data and data[0]:
        planes = _codec()[1].decompress(planes)
    planes = np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def _table(schema: pa.Schema, rows: int, **columns) -> pa.Table:
    """A table of the schema; columns that aren't given are null."""

    def one(f: pa.Field) -> pa.Array:
        given = columns.get(f.name)
        return pa.nulls(rows, f.type) if given is None else given if isinstance(given, (pa.Array, pa.ChunkedArray)) else pa.array(given, f.type)

    return pa.table([one(f) for f in schema], schema=schema)


# --- seating


@functools.cache
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logs of the generalised Stirling numbers: the weight of c customers of a dish at t tables, by c and t."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, most + 1):
            stay = np.log(np.maximum(0.0, c - 1 - discount * t)) + out[c - 1, 1:]
            out[c, 1:] = np.logaddexp(out[c - 1, :-1], stay)
    return out


def uniforms(names: np.ndarray, sweep: int, step: int, seed: int) -> np.ndarray:
    """A number in (0, 1) for each dish, sweep and step."""
    return ((mixed(names ^ np.uint64(mixed(np.array([seed * 1000 + sweep], np.uint64), 60)[0]), 61 + step) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


@dataclass
class Own:
    """Strengths of a parent's dishes: (theta + d * tables of the restaurant) / (v + 1) for each further table."""

    others: np.ndarray
    theta: float
    discount: float
    v: int

    def strength(self, at: slice | np.ndarray, tables) -> np.ndarray:
        return (self.theta + self.discount * (self.others[at] + tables)) / (self.v + 1)

    def opened(self, at: slice | np.ndarray, tables, new=1.0) -> None:
        pass

    def ordered(self, order: np.ndarray) -> Own:
        return Own(self.others[order], self.theta, self.discount, self.v)


@dataclass
class Shared:
    """Strengths of a context's dishes: (theta1 + d1 * tables) * p, where each table is a customer of the parent.

    rest: the parent's customers of the word from other contexts; tau: its tables for them, which grow by the chance
    that the customer so far opened one there.
    """

    others: np.ndarray
    theta: float
    discount: float
    rest: np.ndarray
    tau: np.ndarray
    size: float
    base: float
    parent_discount: float

    def _own(self, at, tables) -> np.ndarray:
        return np.maximum(0.0, self.rest[at] + tables - self.parent_discount * self.tau[at])

    def strength(self, at, tables) -> np.ndarray:
        return (self.theta + self.discount * (self.others[at] + tables)) * (self._own(at, tables) + self.base) / self.size

    def opened(self, at, tables, new=1.0) -> None:
        """The table after `tables` tables was opened (new: how many)."""
        self.tau[at] = self.tau[at] + new * self.base / (self._own(at, tables) + self.base)

    def ordered(self, order: np.ndarray) -> Shared:
        return Shared(self.others[order], self.theta, self.discount, self.rest[order], self.tau[order].copy(), self.size, self.base, self.parent_discount)


def reseated(customers: np.ndarray, names: np.ndarray, prior: Own | Shared, discount: float, sweep: int, seed: int) -> np.ndarray:
    """Tables of each dish in a Gibbs step, given the restaurants' other dishes.

    Up to EXACT customers the tables are drawn from their conditional distribution: t tables have the weight S(c, t)
    times the strengths at 1, 2, ... t - 1 tables. The largest of log weight plus a Gumbel number is such a draw.
    Larger dishes are seated one customer after the other, from the sixteenth on in blocks of an eighth of those seated,
    whose new tables are the expected number, rounded at random.
    """
    order = np.argsort(-customers, kind="stable")
    c, names, prior = customers[order], names[order], prior.ordered(order)
    tables = np.minimum(c, 1).astype(np.int64)
    large = int(np.searchsorted(-c, -EXACT, side="left"))  # dishes of more than EXACT customers come first
    several = int(np.searchsorted(-c, -1, side="left"))

    # exact: dishes large .. several, in order of falling size
    weights = log_stirling(discount)
    sizes = c[large:several]
    if len(sizes):
        total = np.zeros(len(sizes))
        best = weights[sizes, 1] - np.log(-np.log(uniforms(names[large:several], sweep, 0, seed)))
        prior.opened(slice(large, several), 0)
        for i in range(1, int(sizes[0])):
            k = int(np.searchsorted(-sizes, -i, side="left"))  # those of more than i customers
            at = slice(large, large + k)
            total[:k] += np.log(prior.strength(at, i))
            prior.opened(at, i)
            value = weights[sizes[:k], i + 1] + total[:k] - np.log(-np.log(uniforms(names[at], sweep, i, seed)))
            better = value > best[:k]
            best[:k][better] = value[better]
            tables[large : large + k][better] = i + 1

    if large:
        prior.opened(slice(0, large), 0)
        live, seen, step = np.arange(large), np.ones(large, np.int64), 0
        while len(live):
            block = np.minimum(np.where(seen < 16, 1, seen // 8), c[live] - seen)
            strength = prior.strength(live, tables[live])
            chance = strength / (strength + np.maximum(seen + (block - 1) / 2 - discount * tables[live], 1e-9))
            new = np.minimum(block, np.floor(block * np.clip(chance, 0.0, 1.0) + uniforms(names[live], sweep, 1000 + step, seed)).astype(np.int64))
            prior.opened(live, tables[live], new)
            tables[live] += new
            seen, step = seen + block, step + 1
            on = seen < c[live]
            live, seen = live[on], seen[on]
    out = np.empty_like(tables)
    out[order] = tables
    return out


def discount_of(ones: int, twos: int) -> float:
    """The usual estimate from how many dishes have one and two customers, kept off the ends."""
    return min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))


# --- counting


@dataclass
class Places:
    """Where pairs lie: a shard by the context's hash; contexts in `keys` are dealt over `parts` shards by the word's."""

    shards: int
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Sorted hashes of words that have short names.
    coded: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        at, split = _find(self.keys, context)
        name = mixed(context, 2)
        if len(self.keys):
            name = np.where(split, mixed(name + mixed(word, 4) % np.maximum(1, self.parts[at]).astype(np.uint64), 5), name)
        return (name % np.uint64(self.shards)).astype(np.int64)

    @property
    def buckets(self) -> int:
        return max(min(self.shards, LEAST_BUCKETS), self.shards // BUCKET_SHARDS)

    def bucket(self, rank: np.ndarray) -> np.ndarray:
        """Buckets of words by their ranks (_rank); they rise with the ranks."""
        return ((rank >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)


def _rank(word: np.ndarray) -> np.ndarray:
    """What orders words in shards and buckets alike."""
    return mixed(word, 7)


def places(docs: DataFrame, shard_bytes: int = SHARD_BYTES, codes: int = CODES) -> Places:
    """Shards for the texts of docs, contexts to split (those of more than a quarter of a shard's tokens), short names."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    if shards < 4:
        return Places(shards)
    share = max(1, int(1e6 * min(1.0, PROBE_BYTES / size)))
    probe = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).select("text")
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, counts = _with_ends(part.column("text"), none)
                k, c = np.unique(_contexts(tokens, counts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["context", "c"])

    counted = save(probe.mapInArrow(run, "context long, c long").groupBy("context").agg(F.sum("c").alias("c")), "probe")
    total = counted.agg(F.sum("c")).first()[0] or 0
    rows = counted.orderBy(F.desc("c"), "context").limit(codes).toArrow()
    release(counted)
    names, c = rows.column("context").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    coded = np.unique(names[names != START])
    large = c >= max(1.0, total * 0.25 / shards)
    at, short = _find(coded, names[large])
    keys = np.where(short, at.astype(np.uint64), names[large])
    up = np.argsort(keys)
    return Places(shards, keys[up], np.ceil(4 * shards * c[large] / total).astype(np.int64)[up], coded)


def _packed(places_: Places, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct pairs by shard and context, and their shards in that order."""
    shard = places_.of(context, word)
    # 30 bits that keep a context's pairs together: a short name, or the upper bits of a hash
    near, bits = np.where(context >= TOP, context >> np.uint64(34), context), len(context).bit_length()
    if places_.shards.bit_length() + 30 + bits > 64:
        order = np.lexsort((near, shard))
    else:
        both = (((shard.astype(np.uint64) << np.uint64(30)) | near) << np.uint64(bits)) | np.arange(len(context), dtype=np.uint64)
        both.sort()
        order = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    return order, shard[order]


def _gatherer(batches: Iterator[pa.RecordBatch], coded: np.ndarray, least: int, columns: list[str]) -> Iterator[tuple]:
    """Runs of texts with about `least` tokens: tokens, counts, and the columns' arrays."""
    held, size = [], 0
    batch = part = tokens = counts = None
    for batch in batches:
        for part in slices(batch, most=1 << 20):
            tokens, counts = _with_ends(part.column("text"), coded)
            held.append((tokens, counts, [part.column(c) for c in columns]))
            size += len(tokens)
            if size >= least:
                whole, held, size = _joined(held), [], 0
                yield whole
                del whole
                trim()
    del batch, part, tokens, counts
    if held:
        whole, held = _joined(held), []
        yield whole
        del whole
    trim()


def _joined(held: list[tuple]) -> tuple:
    columns = [pa.concat_arrays(c) for c in zip(*(h[2] for h in held), strict=True)]
    return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), columns


SENT = "shard int, contexts binary, lengths binary, words binary, counts binary"
#: A shard's restaurants: contexts with customers (n), dishes of one customer (ones) and of more (several); the words
#: of both kinds of dishes in order of contexts, and customers (c) of the second kind.
BOOK = "contexts binary, n binary, ones binary, several binary, single binary, words binary, c binary"
#: Their seating: tables (t) of the dishes of several customers, the sum of these over the kept sweeps (ts), and the
#: contexts' tables in the kept sweeps, one after the other (kept).
SEATING = "t binary, ts binary, kept binary"
COUNTED = f"shard int, {BOOK}, bucket int, word binary, wc binary, w1 binary, wk binary, context long, cn long, ct long, pairs1 long, pairs2 long"
#: The words of a bucket, in order of their ranks: customers (c) of their pairs, dishes of one customer (w1), the
#: parent's customers (m) and tables (t), and these two in the kept sweeps, one after the other (ms, ts); sums of these.
WORDS = "bucket int, word binary, c binary, w1 binary, m binary, t binary, ms binary, ts binary, n long, v long, c1 long, c2 long, customers long, total long"
#: For a shard, places of its words in a bucket: of those that have dishes of several customers (several), and of the others.
DEALT = "shard int, several binary, others binary"
#: What a bucket tells a shard of the first kind of words: m and t of each.
TOLD = "told_m binary, told_t binary"


def _names(ddl: str) -> list[str]:
    return [f.split(" ")[0] for f in ddl.split(", ")]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.strip().split(" ") for f in ddl.split(","))])


def gather(docs: DataFrame, places_: Places) -> DataFrame:
    """The restaurants of docs' texts: a row per shard (BOOK), and rows of counts.

    word, wc, w1, wk: the words that a shard has of a bucket, in order of their ranks, and of each its customers, its
    dishes of one customer and of more. context, cn, ct: of each context that is dealt over several shards its customers
    and dishes here. pairs1, pairs2: how many dishes of one and two customers the shard has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(SENT)
        for tokens, counts, _ in _gatherer(batches, places_.coded, RUN_TOKENS, []):
            before = _contexts(tokens, counts)
            names = _named(before, tokens)
            first = _argsort(names)
            starts, c = _runs(names[first])
            first = first[starts]
            context, word = before[first], tokens[first]
            del before, tokens, names
            order, shard = _packed(places_, context, word)
            context, word, c = context[order], word[order], c[order]
            starts, lengths = _runs(shard)
            rows = []
            for s, k in zip(starts.tolist(), lengths.tolist(), strict=True):
                at, sizes = _runs(context[s : s + k])
                rows.append((int(shard[s]), _bytes(context[s : s + k][at], "<u8"), _bytes(sizes, "<u4"), _bytes(word[s : s + k], "<u8"), _bytes(c[s : s + k], "<u4")))
            del context, word, c, order, shard, starts, lengths, first, counts
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            del rows

    @trimmed
    def count(table: pa.Table) -> pa.Table:
        schema, sent = _schema(COUNTED), {k: table.column(k).to_pylist() for k in ("contexts", "lengths", "words", "counts")}
        context = np.concatenate([np.repeat(_array(x, "<u8"), _array(k, "<u4")) for x, k in zip(sent["contexts"], sent["lengths"], strict=True)])
        word = np.concatenate([_array(x, "<u8") for x in sent["words"]])
        c = np.concatenate([_array(x, "<u4") for x in sent["counts"]]).astype(np.int64)
        shard = table.column("shard")[0].as_py()
        order = _argsort(_named(context, word))
        context, word, c = context[order], word[order], c[order]
        starts = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])])
        context, word, c = context[starts], word[starts], np.add.reduceat(c, starts)
        order = np.argsort(context, kind="stable")
        context, word, c = context[order], word[order], c[order]
        starts, lengths = _runs(context)
        one = c == 1
        n, ones = np.add.reduceat(c, starts), np.add.reduceat(one.astype(np.int64), starts)
        many = c[~one]
        book = {"contexts": _bytes(context[starts], "<u8"), "n": _bytes(n, "<i8"), "ones": _bytes(ones, "<u4"), "several": _bytes(lengths - ones, "<u4"), "single": _bytes(word[one], "<u8"), "words": _bytes(word[~one], "<u8"), "c": _bytes(c[~one], "<i8")}
        out = [_table(schema, 1, shard=[shard], pairs1=[int(one.sum())], pairs2=[int((c == 2).sum())], **{k: [v] for k, v in book.items()})]
        ranks = _rank(word)
        order = _argsort(ranks)
        at, kinds = _runs(ranks[order])
        w1 = np.add.reduceat(one[order].astype(np.int64), at)
        wc, w, bucket = np.add.reduceat(c[order], at), word[order[at]], places_.bucket(ranks[order[at]])
        del order, ranks
        begins, sizes = _runs(bucket)
        cut = [slice(b, b + k) for b, k in zip(begins.tolist(), sizes.tolist(), strict=True)]
        sent = {name: [_bytes(x[i], kind) for i in cut] for name, x, kind in (("word", w, "<u8"), ("wc", wc, "<u8"), ("w1", w1, "<u4"), ("wk", kinds - w1, "<u4"))}
        out.append(_table(schema, len(cut), shard=np.full(len(cut), shard, np.int32), bucket=bucket[begins].astype(np.int32), **sent))
        _, split = _find(places_.keys, context[starts])
        out.append(_table(schema, int(split.sum()), context=context[starts][split].view(np.int64), cn=n[split], ct=lengths[split]))
        return pa.concat_tables(out)

    return save(docs.select("text").mapInArrow(run, SENT).groupBy("shard").applyInArrow(count, COUNTED), "counts", compression="zstd")


def _told(schema: pa.Schema, bucket: int, shards: list[int], several: list[np.ndarray], m: np.ndarray, t: np.ndarray) -> pa.Table:
    """A row of the parent's customers and tables for each shard that has dishes of several customers in the bucket."""
    rows = [(shard, _bytes(m[at], "<u8"), _bytes(t[at], "<u8")) for shard, at in zip(shards, several, strict=True) if len(at)]
    columns = dict(zip(("shard", "told_m", "told_t"), zip(*rows, strict=True), strict=True)) if rows else {}
    return _table(schema, len(rows), bucket=np.full(len(rows), bucket, np.int32), **columns)


def bucketed(held: DataFrame) -> DataFrame:
    """The words of what gather gave: a row per bucket (WORDS), where each pair is one customer of its word, and a row
    per bucket and shard (DEALT, TOLD)."""
    ddl = f"{WORDS}, {DEALT}, {TOLD}"

    @trimmed
    def run(table: pa.Table) -> pa.Table:
        schema, bucket, shards = _schema(ddl), table.column("bucket")[0].as_py(), table.column("shard").to_pylist()
        words = [_array(x, "<u8") for x in table.column("word").to_pylist()]
        ends = np.cumsum([len(x) for x in words])[:-1]
        word = np.concatenate(words)
        order, starts, run_ = _ranked(_rank(word))
        word = word[order[starts]]
        del order, words

        def summed(name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
            values = np.concatenate([_array(x, kind) for x in table.column(name).to_pylist()])
            return values, np.bincount(run_, values, len(word)).astype(np.int64)

        (_, c), (_, w1), (wk, sums) = summed("wc", "<u8"), summed("w1", "<u4"), summed("wk", "<u4")
        m, t = w1 + sums, np.ones(len(word), np.int64)
        parts = [(at[k > 0], at[k == 0]) for at, k in zip(np.split(run_, ends), np.split(wk, ends), strict=True)]
        counts = {"n": c.sum(), "v": len(c), "c1": (c == 1).sum(), "c2": (c == 2).sum(), "customers": m.sum(), "total": t.sum()}
        arrays = {"word": word, "c": c, "w1": w1, "m": m, "t": t}
        return pa.concat_tables([
            _table(schema, 1, bucket=[bucket], **{k: [_bytes(x, "<u8")] for k, x in arrays.items()}, ms=[_bytes(c[:0], "<u8")], ts=[_bytes(c[:0], "<u8")], **{k: [int(x)] for k, x in counts.items()}),
            _table(schema, len(parts), bucket=np.full(len(parts), bucket, np.int32), shard=pa.array(shards, pa.int32()), several=[_bytes(a, "<u4") for a, _ in parts], others=[_bytes(b, "<u4") for _, b in parts]),
            _told(schema, bucket, shards, [a for a, _ in parts], m, t),
        ])

    rows = held.where("word IS NOT NULL").select("bucket", "shard", "word", "wc", "w1", "wk")
    return save(rows.groupBy("bucket").applyInArrow(run, ddl), "buckets", compression="zstd")


# --- fitting


@dataclass
class Model:
    """What scoring needs. known: the words in buckets; dealt: which of them the shards have; books: the shards' restaurants; seating: their
    tables; splits: for each kept sweep the tables of contexts in several shards; split_n: their customers."""

    n: int
    v: int
    d0: float
    d1: float
    theta: float
    places: Places
    known: DataFrame
    dealt: DataFrame
    books: DataFrame
    seating: DataFrame
    sizes: list[float]
    shares: list[float]
    split_n: np.ndarray
    splits: list[np.ndarray]

    @property
    def parent(self) -> tuple[float, np.ndarray, np.ndarray]:
        """What turns a word's customers and tables into its probabilities: (m - d0 * t) / size + share."""
        return self.d0, np.array(self.sizes), np.array(self.shares)

    @property
    def words(self) -> DataFrame:
        """A row for each word: word, wc (its customers) and for each kept sweep m and t (the parent's customers and tables)."""
        return self.words_of(1)

    def words_of(self, least: int) -> DataFrame:
        """The words of at least so many customers."""
        k = len(self.sizes)
        kept = [f"{x}{i}" for x in "mt" for i in range(k)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    c = _array(row["c"], "<u8")
                    chosen = np.flatnonzero(c >= least)
                    m, t = (_array(row[x], "<u8").reshape(k, -1)[:, chosen] for x in ("ms", "ts"))
                    columns = [_array(row["word"], "<u8")[chosen], c[chosen], *m, *t]
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], ["word", "wc", *kept])

        return self.known.select("word", "c", "ms", "ts").mapInArrow(run, ", ".join(f"{c} long" for c in ("word", "wc", *kept)))


SEATED = f"place int, {SEATING}, bucket int, sent binary, context long, ct long"


def _totals(rows: DataFrame, keys: np.ndarray, column: str) -> np.ndarray:
    """Sums by context for the contexts in several shards, at most 100,000, in the order of keys."""
    out = np.zeros(len(keys), np.int64)
    if len(keys):
        sums = rows.where("context IS NOT NULL").groupBy("context").agg(F.sum(column).alias("x")).toPandas()
        at, there = _find(keys, sums["context"].to_numpy(np.int64).view(np.uint64))
        out[at[there]] = sums["x"].to_numpy(np.int64)[there]
    return out


def fit(docs: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 1, shard_bytes: int = SHARD_BYTES) -> Model:
    """The model of the texts of docs."""
    where = places(docs, shard_bytes)
    held = gather(docs, where)
    pairs1, pairs2 = (int(x or 0) for x in held.agg(F.sum("pairs1"), F.sum("pairs2")).first())
    found = bucketed(held)
    n, v, ones, twos, customers = (int(x or 0) for x in found.agg(*(F.sum(x) for x in ("n", "v", "c1", "c2", "customers"))).first())
    d0, d1, theta, total = discount_of(ones, twos), discount_of(pairs1, pairs2), 1.0, v
    split_n, split_t = _totals(held, where.keys, "cn"), _totals(held, where.keys, "ct")
    books = held.where("contexts IS NOT NULL").select("shard", *_names(BOOK))
    dealt = found.where("several IS NOT NULL").select("bucket", *_names(DEALT))
    known = found
    seating: DataFrame | None = None
    sizes, shares, splits = [], [], []
    release()

    for sweep in range(sweeps):
        size, base, keep = theta + customers, (theta + d0 * total) / (v + 1), sweep >= burn_in

        @trimmed
        def seat(book: pa.Table, told: pa.Table, *, sweep=sweep, size=size, base=base, keep=keep, split_t=split_t) -> pa.Table:
            schema = _schema(SEATED)
            if not book.num_rows:
                return schema.empty_table()
            row = book.to_pylist()[0]
            contexts, ones_, several = _array(row["contexts"], "<u8"), _array(row["ones"], "<u4").astype(np.int64), _array(row["several"], "<u4").astype(np.int64)
            word, c = _array(row["words"], "<u8"), _array(row["c"], "<i8")
            parts = told.to_pylist()
            last = [x for x in parts if x["t"] is not None]
            now = last[0] if last else {"t": None, "ts": None, "kept": None}
            t = _array(now["t"], "<u4").astype(np.int64) if last else np.ones(len(c), np.int64)
            ts = _array(now["ts"], "<u4") if now["ts"] else np.zeros(len(c), np.int64)
            of = np.repeat(np.arange(len(contexts)), several)
            tables = ones_ + np.bincount(of, t, len(contexts)).astype(np.int64)
            at, split = _find(where.keys, contexts)
            tables[split] = split_t[at[split]]
            ranks = _rank(word)
            order, starts, place = _ranked(ranks)
            bucket = where.bucket(ranks[order[starts]])
            parts = sorted((x for x in parts if x["told_m"] is not None), key=lambda x: x["bucket"])
            m, parent = (np.concatenate([_array(x[name], "<u8").view(np.int64) for x in parts] or [np.zeros(0, np.int64)])[place] for name in ("told_m", "told_t"))
            del ranks, place, parts
            rest = (m - t).astype(float)
            tau = np.where(rest > 0, np.maximum(1.0, parent * rest / np.maximum(m, 1)), 0.0)
            prior = Shared((tables[of] - t).astype(float), theta, d1, rest, tau, size, base, d0)
            t = reseated(c, _named(contexts[of], word), prior, d1, sweep, seed)
            tables = ones_ + np.bincount(of, t, len(contexts)).astype(np.int64)
            done = {"place": [row["shard"]], "t": [_bytes(t, "<u4")]}
            if keep:
                done |= {"ts": [_bytes(ts + t, "<u4")], "kept": [_bytes(np.concatenate([_array(now["kept"], "<i8"), tables]), "<i8")]}
            sent = np.add.reduceat(t[order], starts) if len(starts) else np.zeros(0, np.int64)
            begins, lengths = _runs(bucket)
            given = [_bytes(sent[i : i + k], "<u8") for i, k in zip(begins.tolist(), lengths.tolist(), strict=True)]
            return pa.concat_tables([
                _table(schema, 1, **done),
                _table(schema, len(given), place=np.full(len(given), row["shard"], np.int32), bucket=bucket[begins].astype(np.int32), sent=given),
                _table(schema, int(split.sum()), context=contexts[split].view(np.int64), ct=tables[split]),
            ])

        told = known.where("told_m IS NOT NULL").select(F.col("shard").alias("place"), "bucket", *_names(TOLD))
        if seating is not None:
            told = told.unionByName(seating.where("t IS NOT NULL").select("place", *_names(SEATING)), allowMissingColumns=True)
        else:
            told = told.withColumns({c: F.lit(None).cast("binary") for c in _names(SEATING)})
        seated = save(books.drop("single").groupBy("shard").cogroup(told.groupBy("place")).applyInArrow(seat, SEATED), "seated", compression="zstd")
        split_t = _totals(seated, where.keys, "ct")

        @trimmed
        def move(bucket: pa.Table, sent: pa.Table, *, sweep=sweep, total=total, keep=keep) -> pa.Table:
            rows, given = bucket.to_pylist(), {x["place"]: x["sent"] for x in sent.to_pylist()}
            row, shards = next(x for x in rows if x["word"] is not None), [x for x in rows if x["shard"] is not None]
            word, w1, t = _array(row["word"], "<u8"), _array(row["w1"], "<u8").view(np.int64), _array(row["t"], "<u8").view(np.int64)
            m = w1.copy()
            places_ = [_array(x["several"], "<u4") for x in shards]
            for x, at in zip(shards, places_, strict=True):
                if len(at):
                    m[at] += _array(given[x["shard"]], "<u8").view(np.int64)
            t = reseated(m, mixed(word, 3), Own((total - t).astype(float), theta, d0, v), d0, sweep, seed)
            row |= {"m": _bytes(m, "<u8"), "t": _bytes(t, "<u8"), "customers": int(m.sum()), "total": int(t.sum())}
            if keep:
                row |= {name: _bytes(np.concatenate([_array(row[name], "<u8"), x.view(np.uint64)]), "<u8") for name, x in (("ms", m), ("ts", t))}
            out = _table(_schema(f"{WORDS}, shard int, {TOLD}"), 1, **{name: [row[name]] for name in _names(WORDS)})
            if sweep + 1 == sweeps:
                return out
            return pa.concat_tables([out, _told(out.schema, row["bucket"], [x["shard"] for x in shards], places_, m, t)])

        left = known.where("word IS NOT NULL").select(*_names(WORDS)).unionByName(dealt, allowMissingColumns=True)
        sent = seated.where("sent IS NOT NULL").select("bucket", "place", "sent")
        moved = save(left.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(move, f"{WORDS}, shard int, {TOLD}"), "words", compression="zstd")
        release(*([known] if sweep else []), *([seating] if seating is not None else []))
        known, seating = moved, seated
        customers, total = (int(x or 0) for x in known.agg(F.sum("customers"), F.sum("total")).first())
        if keep:
            sizes.append(theta + customers)
            shares.append((theta + d0 * total) / (theta + customers) / (v + 1))
            splits.append(split_t)
    known = known.where("word IS NOT NULL").select(*_names(WORDS))
    return Model(n, v, d0, d1, theta, where, known, dealt, books, seating.where("t IS NOT NULL").select("place", *_names(SEATING)), sizes, shares, split_n, splits)


# --- scoring


def _word_values(parent: tuple[float, np.ndarray, np.ndarray], rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Customers and probabilities (rows by kept sweeps) of words that the parent knows."""
    discount, sizes, shares = parent
    m, t = (np.stack([rows.column(f"{x}{i}").to_numpy() for i in range(len(sizes))], axis=1).astype(float) for x in "mt")
    return rows.column("wc").to_numpy(), (m - discount * t) / sizes + shares


def _rare(model: Model, least: int) -> DataFrame:
    """For each bucket and shard the words of the shard that have less than `least` customers, with these and for the kept
    sweeps, one after the other, what the parent has of them: shard, rare_word, rare_c, rare_m, rare_t."""
    k, ddl = len(model.sizes), "shard int, rare_word binary, rare_c binary, rare_m binary, rare_t binary"

    @trimmed
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        row = next(x for x in rows if x["word"] is not None)
        word, c = _array(row["word"], "<u8"), _array(row["c"], "<u8")
        m, t = (_array(row[x], "<u8").reshape(k, -1) for x in ("ms", "ts"))
        out = []
        for x in rows:
            if x["shard"] is not None:
                at = np.concatenate([_array(x["several"], "<u4"), _array(x["others"], "<u4")])
                at = at[c[at] < least]
                if len(at):
                    out.append((x["shard"], _bytes(word[at], "<u8"), _bytes(c[at], "<u8"), _bytes(m[:, at].reshape(-1), "<u8"), _bytes(t[:, at].reshape(-1), "<u8")))
        schema = _schema(ddl)
        return _table(schema, len(out), **dict(zip(schema.names, zip(*out, strict=True), strict=True))) if out else schema.empty_table()

    words = model.known.select("bucket", "word", "c", "ms", "ts")
    return words.unionByName(model.dealt, allowMissingColumns=True).groupBy("bucket").applyInArrow(run, ddl)


class Restaurants:
    """The contexts of one shard, as a shard's row has them, with what a pair's probability needs."""

    def __init__(self, row: dict | None, scalars: dict):
        self.k, self.theta, self.d1 = len(scalars["sizes"]), scalars["theta"], scalars["d1"]
        row = row or {}  # a shard's book and seating
        self.contexts = _array(row.get("contexts"), "<u8")
        ones, several = _array(row.get("ones"), "<u4").astype(np.int64), _array(row.get("several"), "<u4").astype(np.int64)
        self.n = _array(row.get("n"), "<i8").copy()
        tables = _array(row.get("kept"), "<i8").reshape(self.k, -1).copy()
        at, split = _find(scalars["places"].keys, self.contexts)
        self.n[split] = scalars["split_n"][at[split]]
        for i in range(self.k):
            tables[i, split] = scalars["splits"][i][at[split]]
        self.back = ((self.theta + self.d1 * tables) / (self.theta + self.n)).T if len(self.contexts) else np.ones((0, self.k))
        self.words, self.c = _array(row.get("words"), "<u8"), _array(row.get("c"), "<i8")
        self.of = np.repeat(np.arange(len(self.contexts)), several)
        self.own = self.c - self.d1 * _array(row.get("ts"), "<u4") / self.k
        single = _array(row.get("single"), "<u8")
        of_single = np.repeat(np.arange(len(self.contexts)), ones) if len(single) else np.zeros(0, np.int64)
        self.names = np.concatenate([_named(self.contexts[self.of], self.words), _named(self.contexts[of_single], single)])
        self.mass = np.concatenate([self.own, np.full(len(single), 1.0 - self.d1)])

    def sort(self) -> None:
        up = _argsort(self.names)
        self.names, self.mass = self.names[up], self.mass[up]

    def of_pairs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs: customers less discounts over the context's size, back-off (pairs by kept sweeps), whether seen."""
        at, known = _find(self.contexts, context)
        back = np.ones((len(context), self.k))
        back[known] = self.back[at[known]]
        size = np.full(len(context), self.theta)
        size[known] += self.n[at[known]]
        place, seen = _find(self.names, _named(context, word))
        mass = np.zeros(len(context))
        mass[seen] = self.mass[place[seen]] / size[seen]
        return mass, back, seen


def _classes(c: np.ndarray) -> np.ndarray:
    """Classes of counts, eight for each power of two."""
    return np.floor(8 * np.log2(np.maximum(c, 1))).astype(np.int64)


def _least_class(found: list[tuple[int, int]], most: int) -> int:
    """From (class, how many): the class from which on there are at most `most`."""
    found = sorted(found, reverse=True)
    fits = [k for (k, _), below in zip(found, np.cumsum([n for _, n in found]), strict=True) if below <= most]
    return min(fits) if fits else 1 << 30


def _class_sizes(rows: DataFrame) -> list[tuple[int, int]]:
    """Classes of the counts that are packed in the column c, some hundred, and how many counts each has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("c"):
                k, n = np.unique(_classes(_array(data.as_py(), "<i8")), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

    found = rows.select("c").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return [(r["k"], r["n"]) for r in found]


def _least_count(model: Model, most: int) -> int:
    """The count from which on there are at most `most` words."""
    classes = _class_sizes(model.known)
    return math.ceil(2 ** (_least_class(classes, most) / 8)) if classes else 1


def _near(model: Model, least: int) -> dict[str, np.ndarray]:
    rows = model.words_of(least).toArrow()
    keys = rows.column("word").to_numpy().view(np.uint64)
    up = np.argsort(keys)
    c, p = _word_values(model.parent, rows)
    return {"keys": keys[up], "c": c[up], "p": p[up]}


def _frequent(model: Model, scalars: dict, near: dict, most: int) -> dict[str, np.ndarray]:
    """Names and log probabilities of the most frequent pairs of frequent words, at most `most`."""
    columns = ("contexts", "n", "ones", "several", "words", "c", "ts", "kept")
    least = _least_class(_class_sizes(model.books), most)
    if least == 1 << 30:
        return {"names": np.zeros(0, np.uint64), "lp": np.zeros(0)}
    given = model.books.sparkSession.sparkContext.broadcast((scalars, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scalars_, near_ = given.value
        for batch in batches:
            for i in range(batch.num_rows):
                r = Restaurants(batch.slice(i, 1).to_pylist()[0], scalars_)
                at, known = _find(near_["keys"], r.words)
                chosen = np.flatnonzero(known & (_classes(r.c) >= least))
                of = r.of[chosen]
                p = r.own[chosen] / (r.theta + r.n[of]) + (r.back[of] * near_["p"][at[chosen]]).mean(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(r.names[chosen].view(np.int64)), pa.array(np.log10(p))], ["name", "lp"])

    both = model.books.drop("single").join(model.seating, F.col("shard") == F.col("place")).select(*columns)
    rows = both.mapInArrow(run, "name long, lp double").toArrow()
    given.destroy()
    names = rows.column("name").to_numpy().view(np.uint64)
    up = np.argsort(names)
    return {"names": names[up], "lp": rows.column("lp").to_numpy()[up]}


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), near_words: int = NEAR_WORDS, near_pairs: int = NEAR_PAIRS) -> DataFrame:
    """Every text's n_tokens, n_known, train_tokens, base_score and score, with the columns `keep` of docs.

    A token's probability is the mean over the kept sweeps of (customers - d1 * tables) / (theta1 + size) + back * p.
    Frequent pairs are summed where the text is. The other distinct pairs of each text go to their contexts' shards,
    packed by runs of texts; a shard answers with sums by text. Pairs that no training text has, of words that aren't
    broadcast, are joined to the table of words after that.
    """
    spark, k = docs.sparkSession, len(model.sizes)
    scalars = {"theta": model.theta, "d1": model.d1, "sizes": model.sizes, "places": model.places, "split_n": model.split_n, "splits": model.splits}
    least = _least_count(model, near_words)
    near = _near(model, least)
    given = spark.sparkContext.broadcast({"scalars": scalars, "near": near, "pairs": _frequent(model, scalars, near, near_pairs)})
    floor, n, where = model.n + 0.5 * (model.v + 1), model.n, model.places
    chunk = "shard int, run long, contexts binary, lengths binary, words binary, times binary, texts binary, counts binary"
    doc = "text_no int, n_tokens long, n_known long, base_score double, score double"
    names = ["doc_id", *keep]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for c in names for f in docs.schema.fields if f.name == c]

    def asked_of(run: int, tokens: np.ndarray, counts: np.ndarray, columns: list[pa.Array]) -> pa.Table:
        """Rows of a run of texts: what is known of each, and the other pairs for the shards."""
        t, schema = given.value, _schema(f"{chunk}, {doc}")
        near_, pairs = t["near"], t["pairs"]
        lb = np.log10((near_["c"] + 0.5) / floor)
        before, text = _contexts(tokens, counts), np.repeat(np.arange(len(counts)), counts)
        found = _named(before, tokens)
        first, starts, which = _ranked(found)
        first = first[starts]
        found, context, word = found[first], before[first], tokens[first]
        del before, tokens, first, starts
        at, known = _find(near_["keys"], word)
        place, short = _find(pairs["names"], found)
        base, logs = np.zeros(len(found)), np.zeros(len(found))
        base[known], logs[short] = lb[at[known]], pairs["lp"][place[short]]
        own = {"n_known": np.bincount(text, known[which], len(counts)).astype(np.int64), "base_score": np.bincount(text, base[which], len(counts)), "score": np.bincount(text, logs[which], len(counts))}
        whole = pa.schema([*schema, *(pa.field(c, x.type) for c, x in zip(names, columns, strict=True))])
        rows = _table(whole, len(counts), **dict(zip(names, columns, strict=True)), shard=np.full(len(counts), run % where.shards, np.int32), run=np.full(len(counts), run), text_no=np.arange(len(counts), dtype=np.int32), n_tokens=counts, **own)
        out = [rows]
        del found, at, known, place, base, logs
        # the other pairs by shard and context; of each the texts and how often they have it
        left = np.flatnonzero(~short)
        order, shard = _packed(where, context[left], word[left])
        rank = np.full(len(short), -1)
        rank[left[order]] = np.arange(len(order))
        context, word = context[left[order]], word[left[order]]
        mine = np.flatnonzero(rank[which] >= 0)
        entry, c = np.unique(rank[which[mine]] * len(counts) + text[mine], return_counts=True)
        pair, entry = entry // len(counts), entry % len(counts)
        times = np.bincount(pair, minlength=len(order))
        del which, text, mine, pair, rank, left, order
        ends = np.concatenate([[0], np.cumsum(times)])
        starts, lengths = _runs(shard)
        packed = []
        for s, m in zip(starts.tolist(), lengths.tolist(), strict=True):
            runs, sizes = _runs(context[s : s + m])
            a, b = ends[s], ends[s + m]
            packed.append((int(shard[s]), run, _bytes(context[s : s + m][runs], "<u8"), _bytes(sizes, "<u4"), _bytes(word[s : s + m], "<u8"), _bytes(times[s : s + m], "<u4"), _bytes(entry[a:b], "<u4"), _bytes(c[a:b], "<u4")))
        if packed:
            columns_ = dict(zip([f.name for f in _schema(chunk)], zip(*packed, strict=True), strict=True))
            out.append(_table(whole, len(packed), **columns_))
        return pa.concat_tables(out)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (tokens, counts, columns) in enumerate(_gatherer(batches, where.coded, ASK_TOKENS, names)):
            yield from asked_of((TaskContext.get().partitionId() << 32) + number, tokens, counts, columns).to_batches()

    answers = f"run long, {doc}, texts binary, ls binary, rare_texts binary, lb binary, known binary, word long, times long, {', '.join(f'b{i} double' for i in range(k))}"

    @trimmed
    def answer(asked: pa.Table, told: pa.Table) -> pa.Table:
        t, schema = given.value, _schema(answers)
        docs_ = asked.filter(pc.is_valid(asked.column("text_no")))
        whole = pa.schema([*schema, *(pa.field(c, asked.schema.field(c).type) for c in names)])
        kept = _table(whole, len(docs_), **{c: docs_.column(c).combine_chunks() for c in whole.names if c in docs_.column_names})
        out = [kept]

        def more(rows: int, **columns) -> None:
            out.append(_table(whole, rows, **columns))

        chunks = asked.filter(pc.is_null(asked.column("text_no"))).select([f.name for f in _schema(chunk)]).to_pylist()
        if not chunks:
            return kept
        row, rare = {}, []
        for part in told.to_pylist():
            if part["rare_word"] is None:
                row |= {name: value for name, value in part.items() if value is not None}
            else:
                rare.append(part)
        restaurants = Restaurants(row, t["scalars"])
        restaurants.sort()
        rare_keys, rare_c = (np.concatenate([_array(x[name], "<u8") for x in rare] or [np.zeros(0, np.uint64)]) for name in ("rare_word", "rare_c"))
        rare_m, rare_t = (np.concatenate([_array(x[name], "<u8").reshape(k, -1) for x in rare] or [np.zeros((k, 0), np.uint64)], axis=1).T.astype(float) for name in ("rare_m", "rare_t"))
        up = np.argsort(rare_keys)
        rare_keys, rare_c, rare_p = rare_keys[up], rare_c[up], ((rare_m - discount * rare_t) / sizes_ + shares)[up]
        del row, rare, rare_m, rare_t, up
        near_ = t["near"]
        # all chunks of the shard at once: pairs, then entries (a pair in a text), then sums by chunk and text
        word, times = (np.concatenate([_array(x[c], kind) for x in chunks]) for c, kind in (("words", "<u8"), ("times", "<u4")))
        context = np.concatenate([np.repeat(_array(x["contexts"], "<u8"), _array(x["lengths"], "<u4")) for x in chunks])
        by_chunk = [_array(x["texts"], "<u4") for x in chunks]
        texts, sizes = np.concatenate(by_chunk).astype(np.int64), [len(x) for x in by_chunk]
        c = np.concatenate([_array(x["counts"], "<u4") for x in chunks]).astype(np.int64)
        mass, back, _ = restaurants.of_pairs(context, word)
        p = np.ones((len(word), k))
        at, is_near = _find(near_["keys"], word)
        p[is_near] = near_["p"][at[is_near]]
        at, is_rare = _find(rare_keys, word)
        is_rare &= ~is_near
        p[is_rare] = rare_p[at[is_rare]]
        resolved = is_near | is_rare
        logs, lb = np.log10(mass + (back * p).mean(axis=1)), np.zeros(len(word))
        logs[~resolved] = 0.0
        lb[is_rare] = np.log10((rare_c[at[is_rare]] + 0.5) / floor)
        pair, wide = np.repeat(np.arange(len(word)), times), int(texts.max()) + 1
        place = np.repeat(np.arange(len(chunks)), sizes) * wide + texts
        rare_entry = np.flatnonzero(is_rare[pair])
        whole_size = len(chunks) * wide
        here, there = np.unique(place), np.unique(place[rare_entry])
        ls = np.bincount(place, logs[pair] * c, whole_size)[here]
        rare_lb, known = (np.bincount(place[rare_entry], y, whole_size)[there] for y in (lb[pair[rare_entry]] * c[rare_entry], c[rare_entry]))
        edges = np.arange(len(chunks) + 1) * wide
        cut, rare_cut = np.searchsorted(here, edges), np.searchsorted(there, edges)
        rows = {name: [] for name in ("run", "texts", "ls", "rare_texts", "lb", "known")}
        for i, x in enumerate(chunks):
            one, two = slice(cut[i], cut[i + 1]), slice(rare_cut[i], rare_cut[i + 1])
            values = (x["run"], _bytes(here[one] - edges[i], "<u4"), _bytes(ls[one], "<f4"), _bytes(there[two] - edges[i], "<u4"), _bytes(rare_lb[two].astype(float), "<f8"), _bytes(known[two], "<u4"))
            for name, value in zip(rows, values, strict=True):
                rows[name].append(value)
        more(len(chunks), **rows)
        open_ = np.flatnonzero(~resolved[pair])
        if len(open_):
            run_of = np.repeat(np.array([x["run"] for x in chunks]), sizes)
            backs = {f"b{i}": back[pair[open_], i] for i in range(k)}
            more(len(open_), run=run_of[open_], text_no=texts[open_].astype(np.int32), word=word[pair[open_]].view(np.int64), times=c[open_], **backs)
        return pa.concat_tables(out)

    discount, sizes_, shares = model.parent
    # the words of a shard's own pairs that aren't broadcast go to it
    rare = _rare(model, least)
    seats = model.seating.withColumnRenamed("place", "shard")
    told = model.books.unionByName(seats, allowMissingColumns=True).unionByName(rare, allowMissingColumns=True)
    asked = docs.select("doc_id", *keep, "text").mapInArrow(ask, ", ".join([chunk, doc, *fields]))
    release()
    got = save(asked.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(answer, ", ".join([answers, *fields])), "answers", compression="zstd")
    # what was broadcast has been used: executors and their Python workers let it go
    given.destroy()
    release()

    @trimmed
    def add(table: pa.Table) -> pa.Table:
        texts, rare_texts = (np.concatenate([_array(x, "<u4") for x in table.column(c).to_pylist()]) for c in ("texts", "rare_texts"))
        size = int(texts.max()) + 1
        sums = {
            name: np.bincount(at, np.concatenate([_array(x, kind) for x in table.column(name).to_pylist()]), size).astype(float)
            for name, kind, at in (("ls", "<f4", texts), ("lb", "<f8", rare_texts), ("known", "<u4", rare_texts))
        }
        return pa.table({"run": np.full(size, table.column("run")[0].as_py()), "text_no": np.arange(size, dtype=np.int32), **sums})

    sums = got.where("ls IS NOT NULL").select("run", "texts", "ls", "rare_texts", "lb", "known").groupBy("run").applyInArrow(add, "run long, text_no int, ls double, lb double, known double")
    # pairs that no training text has, of words that aren't broadcast: the word may be known, or not
    open_ = got.where("times IS NOT NULL").join(model.words, "word", "left")
    ps = [F.coalesce((F.col(f"m{i}") - model.d0 * F.col(f"t{i}")) / model.sizes[i], F.lit(0.0)) + model.shares[i] for i in range(k)]
    chance = sum((F.col(f"b{i}") * ps[i] for i in range(k)), F.lit(0.0)) / k
    open_ = open_.select(
        "run", "text_no", (F.col("times") * F.log10(chance)).alias("ls"), (F.col("times") * F.log10((F.coalesce("wc", F.lit(0)) + 0.5) / floor)).alias("lb"),
        F.when(F.col("wc").isNotNull(), F.col("times")).otherwise(0).cast("double").alias("known"),
    )
    more = sums.unionByName(open_).groupBy("run", "text_no").agg(F.sum("ls").alias("ls"), F.sum("lb").alias("lb"), F.sum("known").alias("known"))
    rows = got.where("n_tokens IS NOT NULL").select("run", *names, *(f.split(" ")[0] for f in doc.split(", ")))
    out = rows.join(more, ["run", "text_no"], "left")

    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(F.col(b), F.lit(0.0))

    return out.select(*names, "n_tokens", plus("n_known", "known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base_score", "lb").alias("base_score"), plus("score", "ls").alias("score"))


def held_out_scores(docs: DataFrame, folds: int = 5, fold: int = 1, **options) -> DataFrame:
    """Fits on all documents but those of one fold (by crc32 of the id) and scores all."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))
    marked = docs.select("doc_id", "text", held.alias("held_out"))
    model = fit(marked.where("NOT held_out"), **options)
    return score(marked, model, ("held_out",)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
