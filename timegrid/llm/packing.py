"""Best-fit packing by minimum bin slack.

Texts are tokenised where they lie; a document longer than a sequence is cut into full pieces and a rest. Pieces that
fill a sequence alone are done. The others are dealt by hash into groups of bounded size; a group fills one bin at a
time: its longest piece goes in, a subset-sum over the lengths at hand, held as the bits of an integer, finds the
fullest feasible combination, and that is taken out. A group leaves its last bins short; the pieces of bins with more than
SLACK free places, of all groups, are dealt anew and packed once more.

Defined cases: null and empty texts are the end id alone; repeated rows are separate documents; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import save, slices

SEQUENCE = 2048
GROUP = 8192
SLACK = 32
#: Words whose ids a worker keeps (half of them when there are more: those met most often), and bytes of text that it takes
#: at a time: three workers share an executor's memory.
KNOWN_WORDS = 300_000
TEXT_BYTES = 4 << 20
#: Letters of ASCII and Latin-1, then ASCII marks but the apostrophe: the tokenizer cuts such a word just there.
SIMPLE = r"\A(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)\z"
#: How byte-level vocabularies write the bytes of letters: most as the character of that number, the rest after 255.
SPELLING = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Stands between words that are encoded together; a word of its own for the tokenizer.
MARK = b"\x01"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _objects(strings: pa.Array) -> list:
    """The array's Python objects, by way of numpy: to_pylist makes a scalar of each first."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _picked(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of pool one after the other."""
    total = np.cumsum(lengths)
    source = np.repeat((starts - (total - lengths)).astype(np.int32), lengths)
    source += np.arange(len(source), dtype=np.int32)
    return pool[source]


class WordIds:
    """Ids of texts by way of their words: a word's ids don't depend on its neighbours, so each is encoded once."""

    def __init__(self, path: str, end_id: int = 0, most: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.most = Tokenizer.from_file(path), end_id, most
        mark = self._encode(MARK.decode())
        self.mark = mark[0] if len(mark) == 1 else -1
        self.model = self.tokenizer.model
        self._empty()

    def _empty(self) -> None:
        self.known: dict[bytes, int] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.pool = np.empty(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 17, np.int32)  # word w has the ids from ends[w] to ends[w + 1]
        self.met = np.zeros(1 << 17, np.int32)  # in how many slices of text it was
        self.pool[0], self.ends[1], self.size = self.end_id, 1, 1  # word 0 is the end of a text

    def forget(self, left: int = 0) -> None:
        """Keeps the `left` words met in most slices (of equals the later ones), and halves what counts for them."""
        words, met, ends, pool = list(self.known), self.met[1 : self.size], self.ends[: self.size + 1], self.pool
        kept = np.sort(np.argsort(met, kind="stable")[len(met) - min(left, len(met)) :])
        starts, lengths = ends[kept + 1].astype(np.int64), np.diff(ends)[kept + 1].astype(np.int64)
        self._empty()
        self._keep([words[i] for i in kept.tolist()], _picked(pool, starts, lengths), np.cumsum(lengths))
        self.met[1 : self.size] = met[kept] // 2

    def _learn(self, words: list[bytes]) -> None:
        """Adds the ids of new words. Most are letters and then marks, whose ids are those of the two parts one after
        the other; the letters, in the vocabulary's spelling, go to the model at once. Others go through the whole
        tokenizer, many in one call with a mark between them; words with the mark's own character go one by one.
        """
        both = pc.extract_regex(pa.array(words, pa.binary()).cast(pa.string()), pattern=SIMPLE)
        simple = pc.is_valid(both).to_numpy(zero_copy_only=False)
        both = both.drop_null()
        letters = pc.utf8_lower(pc.struct_field(both, "letters")).dictionary_encode()
        marks = pc.struct_field(both, "marks").dictionary_encode()
        spelled = [x if x.isascii() else x.encode().decode("latin-1").translate(SPELLING) for x in _objects(letters.dictionary)]
        parts = [self._part(x) for x in spelled + _objects(marks.dictionary)]
        pool = np.fromiter(itertools.chain.from_iterable(parts), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        which = np.stack([letters.indices.to_numpy(), marks.indices.to_numpy() + len(spelled)], axis=1).reshape(-1)
        self._keep(list(itertools.compress(words, simple.tolist())), _picked(pool, (np.cumsum(sizes) - sizes)[which], sizes[which]), np.cumsum(sizes[which])[1::2])
        other = list(itertools.compress(words, (~simple).tolist()))
        plain, odd = [w for w in other if MARK not in w], [w for w in other if MARK in w]
        for i in range(0, len(plain), 5000):
            part = plain[i : i + 5000]
            joined = (b" " + MARK + b" ").join([*part, b""]).decode()
            found = np.array(self._encode(joined), np.uint32)
            marks = np.flatnonzero(found == self.mark)
            if len(marks) == len(part):
                self._keep(part, found[found != self.mark], marks - np.arange(len(part)))
            else:
                odd += part
        for w in odd:
            found = np.array(self._encode(w.decode()), np.uint32)
            self._keep([w], found, np.array([len(found)]))

    def _part(self, spelled: str) -> tuple[int, ...]:
        known = self.parts.get(spelled)
        if known is None:
            known = self.parts[spelled] = tuple([t.id for t in self.model.tokenize(spelled)])
        return known

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _keep(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        n = self.size
        start = int(self.ends[n])
        if start + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(self.pool), len(ids)), np.uint32)])
        if n + len(words) >= len(self.ends):
            self.ends, self.met = (np.concatenate([x, np.zeros(max(len(x), len(words)), np.int32)]) for x in (self.ends, self.met))
        self.pool[start : start + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = start + ends
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.size += len(words)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), each with the end id after it, and how many each text has."""
        if self.size > self.most:
            self.forget(self.most // 2)
        lists = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().cast(pa.binary()).dictionary_encode()
        names = _objects(coded.dictionary)
        at = np.fromiter(map(self.known.get, names, itertools.repeat(-1)), np.int32, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [names[i] for i in new.tolist()]
            self._learn(fresh)
            at[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int32, len(fresh))
        self.met[at] += 1
        word = at[coded.indices.to_numpy(zero_copy_only=False)] if names else np.empty(0, np.int32)
        stops = np.cumsum(counts)
        word = np.insert(word, stops, 0)
        starts = self.ends[word]
        lengths = self.ends[word + 1] - starts
        ends = np.cumsum(lengths)[stops + np.arange(len(texts))]
        return _picked(self.pool, starts, lengths), np.diff(ends, prepend=0)


_by_path: dict[tuple[str, int], WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, end_id) not in _by_path:
            _by_path[tokenizer, end_id] = WordIds(tokenizer, end_id)
        words = _by_path[tokenizer, end_id]
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                ids, counts = words.ids(part.column("text").cast(pa.string()).fill_null(""))
                rows, at, data = [], 0, memoryview(ids.astype("<u4")).cast("B")
                for doc, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    for p, s in enumerate(range(0, n, sequence)):
                        e = min(n, s + sequence)
                        rows.append((doc, p, s, e - s, zlib.crc32(data[4 * (at + s) : 4 * (at + e)])))
                    at += n
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def fullest(counts: np.ndarray, descending: list[int], slack: int) -> list[int]:
    """Lengths whose sum is the largest that fits slack: subset sums are bits, kept step by step to walk back."""
    reach, steps, mask = 1, [], (1 << (slack + 1)) - 1
    for length in descending:
        if length > slack:
            continue
        for _ in range(min(int(counts[length]), slack // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> slack:
            break
    left, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            chosen.append(length)
            left -= length
    return chosen


def fill(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (all at most `sequence`)."""
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    counts = np.bincount(lengths, minlength=sequence + 1)
    first = np.searchsorted(sorted_lengths, np.arange(sequence + 1))
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    descending = [int(x) for x in np.flatnonzero(counts)[::-1]]
    number = 0
    while descending:
        longest = descending[0]
        counts[longest] -= 1
        at = 0
        chosen = fullest(counts, descending, sequence - longest)
        for length in chosen:
            counts[length] -= 1
        for length in (longest, *chosen):
            row = order[first[length]]
            first[length] += 1
            bins[row], offsets[row] = number, at
            at += length
        descending = [x for x in descending if counts[x]]
        number += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, group: int = GROUP, end_id: int = 0) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    cut = save(pieces(docs, tokenizer, sequence, end_id), "pieces").withColumn("_row", F.monotonically_increasing_id())
    alone, loose = cut.where(F.col("length") == sequence), cut.where(F.col("length") < sequence)
    groups = max(1, -(-loose.count() // group))
    loose = loose.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets = fill(lengths, sequence)
        ids = bins + table.column("_group").to_numpy() * (1 << 32)
        free = sequence - np.bincount(bins, lengths)[bins].astype(np.int64)
        out = table.select(_columns).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
        return out.append_column("_row", table.column("_row")).append_column("_free", pa.array(free))

    _columns = [f.split(" ")[0] for f in PIECES.split(", ")]
    schema = f"{PIECES}, sequence_id long, offset long, _row long, _free long"
    packed = loose.groupBy("_group").applyInArrow(run, schema)
    full = alone.select(*_columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if groups > 1:
        packed = save(packed, "packed")
        short = packed.where(F.col("_free") > SLACK).drop("sequence_id", "offset", "_free")
        more = max(1, -(-short.count() // group))
        dealt = short.withColumn("_group", groups + F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(more)))
        packed = packed.where(F.col("_free") <= SLACK).unionByName(dealt.groupBy("_group").applyInArrow(run, schema))
    return packed.drop("_row", "_free").unionByName(full)
