"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

One dictionary is trained on ordinary text by zstandard's own trainer. The other is trained on toxic text: it has the
same content and, after it, the word beginnings that toxic text is made of and ordinary text isn't. (The trainer alone
takes what is frequent, in toxic text too mostly ordinary syllables; two dictionaries by it differ by chance, and
windows with slurs gain no more than others: README has the figures.) So the distance of a window, its compressed length with
the first less that with the second, is nearly 0 for ordinary words, and a few bytes where the second dictionary fits.

A window is some words of at least WINDOW bytes, lower-cased, punctuation as blanks. It ends in a fixed tail that both
dictionaries hold: a match finder doesn't look into a frame's last bytes. How many windows of a document reach each of
a few distances, and what share of all, are weighed by a logistic fit on the labelled sample, which so calibrates the
thresholds. Every window of a whole text counts; a document's windows are never gathered, only counted.

Labelled rows: at most `sample` of each label in expectation (chosen by a hash of doc_id) are learned from, and a word
beginning is counted once for each word before it, so copies of a text don't add. All other work covers every
document: one scan, no shuffle.

Defined cases: null texts count as empty, an empty text has no windows and the score of the fit for that; labels that
are null don't count, of repeated labels of a document the smallest does; without labels of both kinds every score is
the smoothed share of label 1; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import save, slices

SAMPLE = 6_000
#: Bytes of words in a window, of the ordinary dictionary, and of the windows that it is trained on.
WINDOW = 32
ORDINARY = 32 << 10
TRAINING = 3 << 20
#: A beginning belongs to toxic text if its lower confidence bound is so many times as frequent there, in this many places.
RATIO = 4.0
PLACES = 5
SHORTEST, LONGEST = 3, 12
MOST = 4_000
ACCEPT = 0.5
TAIL = b" \nqzjxkvwqgzjxqkvz"
#: Thresholds of a window's distance, in bytes.
DISTANCES = (1, 2, 3, 4, 5, 6)
_TO_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_BLANK).split()


def windows(text: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """The text's words in runs of at least `size` bytes; the last may be shorter."""
    run, length = [], 0
    for word in words(text):
        run.append(word)
        length += len(word) + 1
        if length >= size:
            yield b" " + b" ".join(run) + TAIL
            run, length = [], 0
    if run:
        yield b" " + b" ".join(run) + TAIL


class Pair:
    """Compressors with the two dictionaries; frames without headers, so that lengths differ by content alone."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.without, self.having = (self._compressor(content + TAIL) for content in (ordinary, ordinary + toxic))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters.from_level(
            3, strategy=zstandard.STRATEGY_LAZY, min_match=5, search_log=7, target_length=32, hash_log=15, chain_log=15, window_log=17,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=settings)

    def tally(self, text: bytes) -> np.ndarray:
        """How many windows have each of DISTANCES or more, and the number of windows."""
        a, b = self.without.compress, self.having.compress
        most = DISTANCES[-1]
        found, n = [0] * (most + 1), 0
        for window in windows(text):
            n += 1
            gain = len(a(window)) - len(b(window))
            if gain > 0:
                found[min(gain, most)] += 1
        return np.array([*(sum(found[d:]) for d in DISTANCES), n], float)


def beginnings(texts: DataFrame) -> list[bytes]:
    """Word beginnings of toxic text, the strongest last; texts: label, text."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                label, before, start = [], [], []
                for y, text in zip(part.column("label").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    found = words(text or b"")
                    seen = {(p, w[:k]) for p, w in zip([b"", *found], found) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}
                    label += [y] * len(seen)
                    before += [p for p, _ in seen]
                    start += [s for _, s in seen]
                yield pa.record_batch({"label": pa.array(label, pa.int32()), "before": pa.array(before, pa.binary()), "start": pa.array(start, pa.binary())})

    seen = texts.mapInArrow(places, "label int, before binary, start binary").distinct()
    counts = seen.groupBy("start").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    counts = save(counts, "beginnings")
    sums = counts.where(F.length("start") == SHORTEST).agg(F.sum("a"), F.sum("b")).first()
    total_a, total_b = (float(x or 0) + 1 for x in sums)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    bound = F.ln(a / total_a) - F.ln(b / total_b) - 2 * F.sqrt(1 / a + 1 / b)
    strong = counts.where(F.col("a") >= PLACES).select("start", "a", "b", bound.alias("bound")).where(F.col("bound") >= math.log(RATIO))
    # the sample is bounded, and so is the list
    rows = [(r["bound"], bytes(r["start"]), r["a"]) for r in strong.orderBy(F.desc("bound"), "start").limit(MOST).collect()]
    size = {s: n for _, s, n in rows}
    chosen: list[bytes] = []
    for _, start, _ in rows:
        if any(start.startswith(c) or c.startswith(start) for c in chosen):
            continue
        # the longest beginning that stands for nearly all of the same places
        while longer := [s for s in size if len(s) == len(start) + 1 and s.startswith(start) and size[s] >= 0.8 * size[start]]:
            start = max(longer, key=lambda s: (size[s], s))
        chosen.append(start)
    return chosen[::-1]


def ordinary_dictionary(texts: DataFrame) -> bytes:
    """A dictionary trained on about TRAINING bytes of texts (doc_id, text), chosen by a hash, window by window.

    The trainer finds more in texts that stay together. Of a text longer than a twentieth of all that, windows from all
    its places are chosen by a hash, about so many bytes.
    """
    size = F.octet_length("text")
    total = texts.agg(F.sum(F.least(size, F.lit(TRAINING // 20)))).first()[0] or 0
    order = F.xxhash64("doc_id", "text")
    share = int(min(1.0, TRAINING / max(1, total)) * (1 << 20))
    chosen = texts.where(F.pmod(order, F.lit(1 << 20)) < share).select(order.alias("order"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    rate = min(1.0, TRAINING / 20 / max(1, len(text)))
                    found.append([w[: -len(TAIL)] for w in windows(text) if zlib.crc32(w) < rate * 2**32])
                yield pa.record_batch({"order": part.column("order"), "windows": pa.array(found, pa.list_(pa.binary()))})

    rows = chosen.mapInArrow(cut, "order long, windows array<binary>").collect()
    samples = [bytes(w) for r in sorted(rows, key=lambda r: (r["order"], r["windows"])) for w in r["windows"]]
    try:
        return zstandard.train_dictionary(ORDINARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: all of it
        return b"".join(samples)[-ORDINARY:]


@dataclass
class Model:
    """The dictionaries' contents and the weights of the fit; prior: the score where there is none."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()
    prior: float = 0.5

    def scores(self, tallies: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(tallies), self.prior)
        return _chance(_inputs(tallies) @ np.array(self.weights))


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _inputs(tallies: np.ndarray) -> np.ndarray:
    counts, n = tallies[:, :-1], tallies[:, -1:]
    return np.hstack([np.ones_like(n), np.log1p(counts), np.log1p(n), counts / (n + 3)])


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Logistic weights by Newton's method with a small quadratic penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _chance(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Model:
    """The model of labelled texts (labels: doc_id, label of 0 or 1)."""
    labels = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    chance = F.lit(1.0)
    for y, n in counts.items():
        chance = F.when(F.col("label") == y, min(1.0, sample / n)).otherwise(chance)
    chosen = labels.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < chance * (1 << 20))
    # the sample's size is bounded, so its ids may go to all executors: texts are filtered where they lie
    texts = save(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"), "labelled")
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if not (n.get(0) and n.get(1)):
        return Model(prior=prior)
    toxic = beginnings(texts.select(F.col("label").cast("int").alias("label"), "text"))
    ordinary = ordinary_dictionary(texts.where("label = 0"))
    model = Model(ordinary, b" " + b" ".join(toxic) + b" " if toxic else b"", prior=prior)
    rows = tallied(texts, model, "label long").toPandas()
    tallies, y = np.stack(rows["tally"].to_list()), rows["label"].to_numpy(float)
    weights = _fit(_inputs(tallies), y)
    # the sample may hold the labels in other shares than the table
    share = counts[1] / counts[0] / (n[1] / n[0])
    model.weights = (float(weights[0]) + math.log(share), *weights[1:].tolist())
    return model


def tallied(docs: DataFrame, model: Model, keep: str) -> DataFrame:
    """The tally of every text, with the column `keep` ("name type")."""
    name = keep.split()[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(model.ordinary, model.toxic)
        for batch in batches:
            for part in slices(batch):
                found = [pair.tally(t or b"").tolist() for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.record_batch({name: part.column(name), "tally": pa.array(found, pa.list_(pa.float64()))})

    return docs.select(F.col(name).cast(keep.split()[1]).alias(name), "text").mapInArrow(work, f"{keep}, tally array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, accept: float = ACCEPT) -> DataFrame:
    """Scores every document, learning from labels outside the fold: doc_id, held_out, score, predicted."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))
    model = train(docs, labels.where(~held).select("doc_id", F.col("toxic").alias("label")))

    @F.pandas_udf("double")
    def score(tally: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(tally.to_list())) if len(tally) else [], dtype=float)

    scored = tallied(docs, model, "doc_id long").select("doc_id", held.alias("held_out"), score("tally").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))
