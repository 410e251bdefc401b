"""Compression distances: held-out accuracy on made texts, tallies against a plain loop, odd tables."""

import random

import numpy as np
import pytest

from timegrid.llm import toxicity as X

DOCS = "doc_id long, text string, lang string, label int, tally string, start string"
LABELS = "doc_id long, toxic int"
SLURS = ["zorgface", "blimhead", "grutworm", "snivelbag"]


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["ka", "lo", "min", "te", "ras", "un", "vo", "del", "sha", "pri", "on", "er"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(40, 160))]
        if toxic := rng.random() < 0.3:
            for _ in range(max(3, len(words) // 20)):
                words.insert(rng.randrange(len(words)), rng.choice(SLURS).upper() + rng.choice(["", "!", ","]))
        docs.append((i, " ".join(words), "en", 1, "x", "y"))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def made(spark):
    docs, labels = corpus(700, 3)
    return docs, labels, spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)


def test_held_out_texts_are_told_apart(spark, made):
    _, labels, docs, table = made
    out = X.toxicity(docs, table)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows, truth = out.collect(), dict(labels)
    assert len(rows) == 700 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    # labels of held-out rows take no part
    other = spark.createDataFrame([(i, 1 - t if next(r for r in rows if r.doc_id == i).held_out else t) for i, t in labels], LABELS)
    assert sorted((r.doc_id, round(r.score, 9)) for r in X.toxicity(docs, other).collect()) == sorted((r.doc_id, round(r.score, 9)) for r in rows)


def test_tallies_equal_a_plain_loop(spark, made):
    docs, _, table, labels = made
    model = X.train(table, labels.selectExpr("doc_id", "toxic AS label"))
    assert any(s.encode()[:5] in model.toxic for s in SLURS) and b"zorgface" not in model.ordinary
    pair = X.Pair(model.ordinary, model.toxic)
    for r in X.tallied(table, model, "doc_id long").collect()[:60]:
        text = docs[r.doc_id][1].encode()
        gains = [len(pair.without.compress(w)) - len(pair.having.compress(w)) for w in X.windows(text)]
        assert r.tally == [*(sum(g >= d for g in gains) for d in X.DISTANCES), len(gains)]


def test_windows_hold_every_word_once():
    text = "Ab, c-d  Éa\n" * 50 + "last"
    found = [w[: -len(X.TAIL)] for w in X.windows(text.encode())]
    assert b" ".join(found).split() == X.words(text.encode()) and X.words(b"Ab, c-d") == [b"ab", b"c", b"d"]
    assert all(len(w) >= X.WINDOW for w in found[:-1]) and list(X.windows(b" \n.")) == []


def test_copies_do_not_count_twice(spark):
    docs, labels = corpus(300, 8)
    # one clean text, labelled toxic by mistake and copied many times, gives no word beginnings
    docs += [(1000 + i, "peculiarone peculiartwo peculiarthree", "en", 1, "x", "y") for i in range(60)]
    labels += [(1000 + i, 1) for i in range(60)]
    model = X.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, label int"))
    assert b"peculiar" not in model.toxic


def test_odd_tables(spark, made):
    docs, labels, table, known = made
    odd = [(None, None, None, 1, "x", "y"), (7001, None, None, 1, "x", "y"), (7002, "", "en", 1, "x", "y"), (7003, " \n", "en", 1, "x", "y"), (7004, "zorgface, " * 40_000, "en", 1, "x", "y")]
    again = spark.createDataFrame(docs + docs[:40] + odd, DOCS)
    more = spark.createDataFrame(labels + labels[:9] + [(7001, None), (None, 1)], LABELS)
    rows = X.toxicity(again, more).collect()
    assert len(rows) == 745
    empty = {round(r.score, 12) for r in rows if r.doc_id in (None, 7001, 7002, 7003)}
    assert len(empty) == 1 and next(r for r in rows if r.doc_id == 7004).predicted == 1
    assert X.toxicity(table.limit(0), known).count() == 0
    one = {r.score for r in X.toxicity(table, known.where("toxic = 0")).collect()}
    none = {r.score for r in X.toxicity(table, known.limit(0)).collect()}
    assert len(one) == 1 and one.pop() < 0.01 and none == {0.5}


def test_fit_equals_gradient_zero():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(400), rng.normal(size=(400, 2))])
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [0.3, 2.0, -1.0])))).astype(float)
    w = X._fit(x, y)
    assert np.abs(x.T @ (y - X._chance(x @ w)) - 0.01 * w).max() < 1e-6
