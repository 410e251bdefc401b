"""Shards and buckets of the word model exchange packed words, not a row for each word."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from timegrid.llm import pitman_yor


def _texts() -> list[tuple[int, str]]:
    rng = np.random.default_rng(2)
    return [(i, " ".join([f"one{i}x{j}" for j in range(150)] + [f"w{k}" for k in rng.integers(0, 200, 150)] + ["a a"])) for i in range(20)]


def test_rows_do_not_follow_the_words(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string")
    for shard_bytes, most in ((1 << 20, 10), (8000, 200)):  # one shard; several
        where = pitman_yor.places(docs, shard_bytes, codes=50)
        held = pitman_yor.gather(docs, where)
        assert held.where("word IS NOT NULL").count() <= most < 3000  # distinct words: more than 3000
        rows = pitman_yor.bucketed(held).collect()
        words, pairs = Counter(), Counter()
        for _, t in _texts():
            tokens, counts = pitman_yor._with_ends(pa.array([t]), where.coded)
            words.update(tokens.tolist())
            pairs.update(zip(pitman_yor._contexts(tokens, counts).tolist(), tokens.tolist(), strict=True))
        customers = Counter(w for _, w in pairs)
        several = {(int(where.of(*(np.array([x], np.uint64) for x in k))[0]), k[1]) for k, c in pairs.items() if c > 1}
        found, seen, dealt = {}, {}, set()
        for r in rows:
            if r.word is not None:
                names = pitman_yor._array(r.word, "<u8")
                found[r.bucket] = names
                seen |= {w: (c, m) for w, c, m in zip(names.tolist(), pitman_yor._array(r.c, "<u8").tolist(), pitman_yor._array(r.m, "<u8").tolist(), strict=True)}
        for r in rows:
            if r.several is not None:
                dealt |= {(r.shard, w) for w in found[r.bucket][pitman_yor._array(r.several, "<u4")].tolist()}
        assert seen == {w: (c, customers[w]) for w, c in words.items()} and len(words) > 3000
        assert dealt == several


def test_argsort_is_that_of_numpy():
    rng = np.random.default_rng(3)
    for keys in (rng.integers(0, 1 << 63, 5000).astype(np.uint64)[rng.integers(0, 5000, 9000)], rng.integers(0, 300, 9000).astype(np.uint64), np.zeros(0, np.uint64)):
        order = pitman_yor._argsort(keys)
        assert (order == np.argsort(keys, kind="stable")).all()
        _, starts, run = pitman_yor._ranked(keys)
        assert (np.unique(keys)[run] == keys).all() and len(starts) == len(np.unique(keys))
