"""Helpers that several corpus operators share: shared storage, word splitting, hashing."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One white-space run, as a regular expression of the JVM: the six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
#: One word, the same way.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker tokenises at a time.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir.

    Where that is unset, in local mode only, a folder in the warehouse.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/timegrid/{uuid.uuid4().hex}/{name}"
    _made.append(path.rpartition("/")[0])
    return path


#: Folders made by fresh_dir in this process that still stand.
_made: list[str] = []


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder, read again: the lineage ends there, so a lost executor costs no more than a reread.

    options: those of the Parquet writer.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_in = path.rpartition("/")[0]
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables of `save` that nothing reads any more, and lets Spark's cleaner drop the shuffle files of finished stages."""
    for table in tables:
        remove(table.sparkSession, table._saved_in)
    if spark := SparkSession.getActiveSession():
        spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _made:
        _made.remove(folder)


def remove_all(spark: SparkSession) -> None:
    """Removes all tables, archives and indexes that operators have left in the shared folder in this process.

    A result reads them, so it's to be called when results have been used.
    """
    for folder in list(_made):
        remove(spark, folder)


def word_count(text: Column) -> Column:
    """How many words a text has (null: 0)."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{BLANKS}", "")
    pieces = F.size(F.split(trimmed, BLANKS))
    ends_blank = trimmed.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(pieces - ends_blank).cast("long")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes; a longer text is a run of its own."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def trim() -> None:
    """Gives memory that freed arrays have left back to the system: workers of an executor keep it otherwise, also idle ones."""
    pa.default_memory_pool().release_unused()
    if given_back := getattr(ctypes.CDLL(None), "malloc_trim", None):  # in glibc only
        given_back(0)


def trimmed(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of a group (or two) that calls trim once its arrays are gone."""

    @functools.wraps(run)
    def with_one(table: pa.Table) -> pa.Table:
        out = run(table)
        trim()
        return out

    @functools.wraps(run)
    def with_two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        trim()
        return out

    return with_one if run.__code__.co_argcount == 1 else with_two  # Spark asks how many tables a function takes


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts, A-Z lowered, one after the other, and how many each text has.

    bytes.split cuts at exactly the six ASCII blanks and bytes.lower touches A-Z alone.
    """
    flat: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        words = text.lower().split() if text else []
        counts[i] = len(words)
        flat += words
    return flat, counts


_IS_BLANK = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
_LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def word_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of words_of as one Arrow array, cut by arrays of bytes without a Python object for each word."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = ~_IS_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = solid[firsts]  # the end of a text ends its last word
    counts = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
    letters = _LOWERED[data[solid]]
    cuts = np.append(np.flatnonzero(begins[solid]), len(letters)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(letters)]), counts


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' distinct words, the place among these of each word, and how many words each text has."""
    words, counts = word_array(texts)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)), coded.indices.to_numpy(zero_copy_only=False), counts


def hashes_of(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word; a word that repeats is hashed once."""
    if not words:
        return np.empty(0, np.uint64)
    coded = pa.array(words, pa.binary()).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Another 64-bit hash of 64-bit hashes (a bijection for each salt)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Tally:
    """Counts by 64-bit key, gathered from many arrays in bounded memory: kept sorted and summed, given out when large."""

    def __init__(self, most: int = 1_500_000):
        self.keys, self.counts, self.most = [], [], most
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c.astype(np.int64))
        self.size += len(k)

    def full(self) -> bool:
        if self.size <= 2 * self.most:
            return False
        self.merge()
        return self.size > self.most

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
            counts = np.bincount(where, np.concatenate(self.counts), len(keys)).astype(np.int64)
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merge()
        self.keys, self.counts, self.size = [], [], 0
        return out
