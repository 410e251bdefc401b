"""The manifest against a plain recursive tree."""

import hashlib
import random
import zlib

import pytest

from timegrid.llm import manifest as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, level int, row string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes, paths):
    """Parents of nodes; each path gets its sibling (or None) with the side."""
    up, places = [], {}
    for k in range(0, len(nodes), 2):
        pair = nodes[k : k + 2]
        places |= {k + j: (len(up), None if len(pair) == 1 else (j, pair[1 - j])) for j in range(len(pair))}
        up.append(h(*pair))
    return up, places


def plain(rows):
    """doc_id, leaf, subroot, root, proof digest, folded root, verified of every row, by brute force."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops, done = [], []
    for at, lang in enumerate(order):
        own = sorted(((r, leaf(r[0], r[2], r[1], r[3], r[4])) for r in groups[lang]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        nodes, where, proofs = [x[1] for x in own], list(range(len(own))), [[] for _ in own]
        while len(nodes) > 1:
            nodes, places = climb(nodes, where)
            for j, w in enumerate(where):
                proofs[j].append(places[w][1])
                where[j] = places[w][0]
        tops.append(nodes[0])
        done += [(r, x, nodes[0], proofs[j], at) for j, (r, x) in enumerate(own)]
    nodes, where = tops, list(range(len(tops)))
    ways = [[] for _ in tops]
    while len(nodes) > 1:
        nodes, places = climb(nodes, where)
        for j, w in enumerate(where):
            ways[j].append(places[w][1])
            where[j] = places[w][0]
    out = []
    for r, x, sub, proof, at in done:
        whole = proof + ways[at]
        digest = x
        if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
            digest = leaf(r[0], r[2], r[1], r[3] + 1, r[4])
        for s in whole:
            digest = h(digest) if s is None else h(digest, s[1]) if s[0] == 0 else h(s[1], digest)
        out.append((r[0], x, sub, nodes[0], h(*(s[1] for s in whole if s)), digest, digest == nodes[0]))
    return sorted(out, key=str)


def run(spark, rows, parts=4):
    docs = spark.createDataFrame([(i, t, lang, s, n, "x", 3, "y") for i, lang, s, n, t in rows], DOCS).repartition(parts)
    out = M.tamper_check(docs)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=str)


def table(n, seed, langs):
    rng = random.Random(seed)
    return [(rng.choice([i, i, i, None]) if i % 9 == 0 else i, rng.choice(langs), rng.choice(["a", "é", None]), rng.choice([None, 5, i]), rng.choice(["", None, "tex t" * (i % 50), "ü" * 9])) for i in range(n)]


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (3, ["en"]), (3, ["a", "b", "c"]), (40, [None, "", "z", "é", "Z"]), (900, ["en", "en", "en", "fr", None])])
def test_equals_plain_tree(spark, n, langs):
    rows = table(n, n, langs)
    assert run(spark, rows) == plain(rows)


def test_repeated_rows_and_any_partitioning(spark):
    rows = table(60, 4, ["en", None, "fr"]) + [(5, "en", "a", 2, "same")] * 70 + [(5, "en", "a", 2, "other")]
    assert run(spark, rows, 1) == run(spark, rows, 7) == plain(rows)


def test_joins_of_larger_sides(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(M, "STEP", 2)
    rows = table(150, 8, ["en", "en", "fr"])
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_groups_and_other_keys(spark):
    rows = table(50, 2, ["en", None, "fr"])
    docs = spark.createDataFrame(rows, "id long, lang string, source string, n long, text string")
    made = M.manifest(docs, fields=("id", "text"), key="id", group="source")
    groups = {r["source"]: r["n"] for r in made.groups.collect()}
    assert groups == {s: sum(r[2] == s for r in rows) for s in {r[2] for r in rows}}
    roots = made.proofs.select(M.folded(M.F.col("leaf"), M.F.col("proof"))).distinct().collect()
    assert [r[0] for r in roots] == [made.root]
