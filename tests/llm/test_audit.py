"""The streamed audit against brute force over all orders."""

import os
import random
import re
from itertools import permutations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from timegrid.llm import audit as A

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def fails(rows):
    """Of each row the letters of the filters that it fails."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        bad = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (x or "") == t for j, x, _ in rows),
        }
        out.append({k for k, v in bad.items() if v})
    return out


def plain(rows, labels):
    found, best = fails(rows), {}
    for i, q, t in labels:
        if i is not None:
            a, b = best.get(i, (None, None))
            best[i] = (min((x for x in (a, q) if x is not None), default=None), min((x for x in (b, t) if x is not None), default=None))
    orders, out = list(map("".join, permutations("ABCDE"))), {}
    for part in {r[2] or "" for r in rows}:
        own = [(f, best.get(r[0], (None, None))) for r, f in zip(rows, found) if (r[2] or "") == part]
        shapley = {c: sum(c in f and next(x for x in o if x in f) == c for o in orders for f, _ in own) for c in "ABCDE"}
        for order in orders:
            left = own
            for k, c in enumerate(order):
                gone, stay = [x for x in left if c in x[0]], [x for x in left if c not in x[0]]
                redundant = sum(c in f for f, _ in own) - len(gone)
                out[part, order, k + 1] = (len(stay), len(gone), redundant, sum(f == {c} for f, _ in own), sum(q == 1 for _, (q, _) in gone), sum(t == 1 for _, (_, t) in gone), shapley[c])
                left = stay
    return out


def write(folder, rows, files):
    """The rows over several files, in their order; later files are newer."""
    os.makedirs(folder)
    size = -(-len(rows) // files)
    for k in range(files):
        own = rows[k * size : (k + 1) * size]
        data = pa.table({"doc_id": pa.array([r[0] for r in own], pa.int64()), "text": pa.array([r[1] for r in own], pa.string()), "source": pa.array([r[2] for r in own], pa.string()), "part": pa.array([1] * len(own)), "n": pa.array(["x"] * len(own))})
        pq.write_table(data, f"{folder}/part-{k}.parquet")
        os.utime(f"{folder}/part-{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def cases():
    rng = random.Random(5)
    texts = ["", None, "one two", "A B C", "| a | b |", " ".join(f"w{k}" for k in range(250)), " ".join(["same"] * 300), " ".join(f"W{k % 90}" for k in range(220)), "x " * 9000 + "#"]
    rows = [(i, rng.choice([*texts, f"text {i}"]), rng.choice(["a", "b", None, "", "a"])) for i in range(140)]
    rows += [(None, "one two", "a"), (None, "", None), (7, "one two", "a"), (7, "one two", "b"), (7, "one two", "b"), (7, "other", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("files,batches,order", [(6, 6, -1), (5, 2, 0)])
def test_equals_brute_force_in_any_order_of_arrival(spark, tmp_path, files, batches, order):
    rows, labels = cases()
    # -1: the largest ids come first, so almost every batch retracts
    arrival = sorted(rows, key=lambda r: order * (r[0] or 0)) if order else random.Random(1).sample(rows, len(rows))
    write(f"{tmp_path}/docs", arrival, files)
    found = A.filter_audit(spark, f"{tmp_path}/docs", spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), batches)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in found.collect()}
    assert got == plain(rows, labels)


def test_one_text_that_fills_the_table(spark, tmp_path):
    rows = [(i, "hot text", "a" if i % 3 else "b") for i in range(900, 0, -1)]
    write(f"{tmp_path}/docs", rows, 4)
    counts = {(r["part"], r["mask"]): r["n"] for r in A.counters(spark, f"{tmp_path}/docs", spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert counts == {("a", 1): 1, ("a", 17): 599, ("b", 17): 300}


def test_empty_table(spark, tmp_path):
    write(f"{tmp_path}/docs", [], 1)
    assert A.filter_audit(spark, f"{tmp_path}/docs/part-0.parquet", spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
