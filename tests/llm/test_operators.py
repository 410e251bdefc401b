"""Corpus operators against brute force on small tables with nulls, blanks, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timegrid.llm import archive, bitslices, common, fingerprints, language, mixing, ngram_join, packing, pieces, pitman_yor, rules
from timegrid.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string"
tokenizers = pytest.importorskip("tokenizers")
vocabulary = pytest.importorskip("public_tokenizers")
PATH = vocabulary.path("word_bpe_49k.json")


def words(rng, n, stem="w", kinds=400):
    return [f"{stem}{rng.randrange(kinds)}" for _ in range(n)]


def table(spark, rows):
    """rows: (doc_id, text, source); the further columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x") for i, t, s in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, " ".join(words(rng, rng.choice([0, 1, 3, 40, 90, 200]))), rng.choice(["a", "b", None, "c"])) for i in range(60)]
    base = words(rng, 120, "p", 10_000)
    for i in range(60, 75):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(9999)}"
        out.append((i, " ".join(copy), "a"))
    out += [(75, out[10][1].upper(), "b"), (76, None, None), (77, "", "b"), (78, " \t\n", "b"), (79, " ".join(words(rng, 6000, "long", 5000)), "c"), (80, "é ß ﬁ", "c"), (81, "é  SS fi", "c"), (82, "two words", "a"), (83, "TWO words", "a")]
    out += [out[5], out[5], (12, "other text under a repeated id", "a")]
    return out


# --- packing


def test_packing(spark, rows):
    got = packing.pack(table(spark, rows), PATH, group=20).collect()
    tok = tokenizers.Tokenizer.from_file(PATH)
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p in range(0, len(ids), 2048):
            want[i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_word_ids_survive_marks_and_forgetting():
    w = packing.WordIds(PATH, most=2)
    texts = ["a \x01 b", "x\x01y ünï ok", "", "don't STOP's", "ÀÉÎ, ÿ. ×÷ ªº µ İstanbul ΑΣ", "e\u0301a 漢字 🙂ok <|endoftext|>x", "$$$ (word) x1y2 nb\u00a0sp"]
    for _ in range(3):
        ids, counts = w.ids(pa.array(texts))
        want = [[*tokenizers.Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_fullest_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        slack = rng.randrange(0, 60)
        counts = np.bincount(lengths, minlength=64)
        got = packing.fullest(counts, sorted(set(lengths), reverse=True), slack)
        best = max((s for k in range(len(lengths) + 1) for c in combinations(lengths, k) if (s := sum(c)) <= slack), default=0)
        assert sum(got) == best and not Counter(got) - Counter(lengths)


# --- mixing


def water(sizes, weights, rounds=3):
    left, free, out = float(sum(sizes)), set(range(len(sizes))), {}
    while free:
        level = left / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > rounds * sizes[i]}
        if not over:
            out |= {i: level * weights[i] for i in free}
            break
        out |= {i: float(rounds * sizes[i]) for i in over}
        left -= sum(rounds * sizes[i] for i in over)
        free -= over
    return out


def test_mixing(spark, rows):
    docs = table(spark, rows)
    got = mixing.mix(docs, carry=("source AS s",)).collect()
    again = mixing.mix(docs.repartition(5), carry=("source AS s",)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    names = sorted({r.s for r in got}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in got if r.s == s) for s in names]
    want = water(sizes, [1 + i % 3 for i in range(len(names))])
    for i, s in enumerate(names):
        mine = [r for r in got if r.s == s]
        assert all(r.target == pytest.approx(want[i]) and r.source_size == sizes[i] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[i]) <= mixing.BLOCK_WORDS
    assert all(0 <= r.taken <= 3 * r.size for r in got)


def test_apportionment_equals_highest_quotients(spark):
    rng = random.Random(4)
    groups = {g: ([rng.choice([0, 1, 5, 50, 1000]) for _ in range(rng.randrange(1, 9))], rng.randrange(0, 60)) for g in range(20)}
    df = spark.createDataFrame([(g, k, v, s) for g, (votes, s) in groups.items() for k, v in enumerate(votes)], "g int, k int, v long, s long")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(df, ["g"], "k", F.col("v"), F.col("s")).collect()}
    for g, (votes, seats) in groups.items():
        ranked = sorted(((-v / (2 * j + 1), k, j) for k, v in enumerate(votes) if v for j in range(seats)))[:seats]
        assert {k: got[g, k] for k in range(len(votes))} == {k: sum(x[1] == k for x in ranked) for k in range(len(votes))}


def test_mixed_documents_keep_columns(spark, rows):
    out = mixing.mixed_documents(table(spark, rows))
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert max(Counter(r.doc_id for r in out.where("doc_id not in (5, 12)").collect()).values()) <= 3


# --- fingerprints


def fold(text):
    nfkc = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    blank = (" " if unicodedata.category(c)[0] == "Z" or unicodedata.category(c) == "Cc" else c for c in nfkc)
    return " ".join("".join(blank).split())


def test_mixes_of_repeated_ids_agree(spark):
    rng = random.Random(9)
    rows = [(i % 40, f"{'abcdefghij'[k]} " * 37 + f"{i % 40}", "s") for k in range(10) for i in range(40)]
    rows += [(rng.randrange(1000), "other words " * rng.randrange(1, 60), rng.choice(["t", "u", None])) for _ in range(300)]
    seen = [sorted((r.doc_id, r.text) for r in mixing.mixed_documents(table(spark, rng.sample(rows, len(rows))).repartition(n)).collect()) for n in (2, 9)]
    assert seen[0] == seen[1]


def test_fingerprints(spark, rows):
    single = {}
    for i, t, _ in rows:
        single.setdefault(i, t or "")
    docs = table(spark, [(i, t, "a") for i, t in single.items()])
    order = sorted(single, reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert len(got) == len(single)
    prints = {}
    for n, i in enumerate(order):
        text, after = single[i], single[order[(n + 1) % len(order)]]
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(fold(text) == fold(edited)) and r.near_next == float(fold(text) == fold(after))
        prints.setdefault(fold(text), set()).add(r.fingerprint)
        prints.setdefault(fold(edited), set()).add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)


def test_fingerprints_of_repeated_rows_and_collisions(spark, rows):
    assert fingerprints.edited_fingerprints(table(spark, rows)).count() == len(rows)
    assert fingerprints.edited_fingerprints(table(spark, rows[:1])).first().near_next == 1.0
    by_text = {}
    for r in fingerprints.group_digests(table(spark, rows[:60])).collect():
        by_text.setdefault(rows[r.doc_id][1] or "", set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in by_text.values())
    texts = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "c"), ("e", "c")], "digest string, _canonical string")
    assert [r.digest for r in fingerprints.unlike(texts).collect()] == ["d"]


def test_fingerprints_without_ids(spark):
    docs = table(spark, [(None, "abcdef", "a"), (5, "ABC xyz", "a"), (None, None, "a")])
    got = {(r.doc_id, r.n_chars): r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert set(got) == {(None, 6), (5, 7), (None, 0)} and len({r.fingerprint for r in got.values()}) == 3


# --- n-gram join


def brute_components(rows, n, percent):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[x] = y
    least = {}
    for a in range(len(rows)):
        least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0])
    return Counter((rows[a][0], len(sets[a]), least[find(a)]) for a in range(len(rows)))


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 50)])
def test_ngram_join(spark, rows, n, percent):
    rows = [r for r in rows if r[1] != "other text under a repeated id"]
    got = ngram_join.linked(table(spark, rows), n, percent)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows, n, percent)


def test_dense_group_emits_few_pairs(spark):
    rng = random.Random(9)
    base = words(rng, 150, "q", 10_000)
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(99999)}"
        rows.append((i, " ".join(copy), "a"))
    got = ngram_join.linked(table(spark, rows), 4, 85)
    assert Counter(map(tuple, got.collect())) == brute_components(rows, 4, 85)


def test_first_of_each(spark, rows):
    kept = sorted(r.doc_id for r in ngram_join.first_of_each(table(spark, rows), 4, 85).collect())
    plain = [r for r in rows if r[1] != "other text under a repeated id"]
    firsts = {c for _, _, c in brute_components(plain, 4, 85)}
    # the other text of the repeated id has no like one, so both rows of that id stay
    assert Counter(kept) == Counter(firsts) + Counter([12])


def test_rows_of_one_id_and_without_id(spark):
    text = " ".join(f"t{i}" for i in range(30))
    data = [(1, text, "a"), (1, "some other words that are unlike", "b"), (2, text + " end", "c"), (None, text, "d"), (None, None, "e"), (3, "some other words that are unlike", "f"), (3, "some other words that are unlike", "f")]
    docs = table(spark, data)
    got = Counter(map(tuple, ngram_join.linked(docs, 5, 80).collect()))
    assert got == Counter([(1, 26, 1), (1, 2, 1), (2, 27, 1), (None, 26, 1), (None, 0, None), (3, 2, 1), (3, 2, 1)])
    kept = sorted((r.doc_id or 0, r.source) for r in ngram_join.first_of_each(docs, 5, 80).collect())
    assert kept == [(0, "e"), (1, "a"), (1, "b")]


def test_a_passage_in_every_document_links_nothing(spark):
    rng = random.Random(21)
    passage = words(rng, 60, "p", 10_000)
    rows = [(i, " ".join(words(rng, 100, "w", 50_000) + passage), "a") for i in range(80)]
    assert Counter(map(tuple, ngram_join.linked(table(spark, rows), 4, 85).collect())) == brute_components(rows, 4, 85)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (3, 1)], "a long, b long")
    roots = {r.v: r.root for r in components(edges).collect()}
    assert len({roots[v] for v in (1, 2, 3)}) == len({roots[v] for v in (5, 6, 7, 8, 9)}) == 1 and roots[1] != roots[5]


def test_rising_paths_shrink_fast(spark, monkeypatch):
    from timegrid.llm import components as module

    rounds = []
    monkeypatch.setattr(module, "save", lambda df, name: (rounds.append(name), common.save(df, name))[1])
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert len({r.root for r in module.components(edges).collect()}) == 1 and rounds.count("pointers") < 30


# --- archives


def pages_table(spark):
    big = "<html>" + "x" * 1200
    rows = [(1, "http://www.B.example.com/x?q=1", big), (2, "https://a.example.com/", big), (3, "http://a.example.com/y", big + "z"), (4, None, "small"), (5, "http://c.org", "small"), (6, "http://c.org", None), (7, "http://c.org", ""), (3, "http://a.example.com/y", big + "z"), (8, "not an address", "é" * 600)]
    return spark.createDataFrame([(i, u, h, "k", 0) for i, u, h in rows], "page_id long, url string, html string, key string, offset int"), rows


def test_archive_round_trip(spark):
    pages, rows = pages_table(spark)
    got = archive.round_trip(pages).collect()
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    lead = {}
    for i, b in payload:
        if len(b) >= 1000:
            lead[b] = max(lead.get(b, i), i)
    want = Counter()
    done = set()
    for i, b in payload:
        first = len(b) < 1000 or (lead[b] == i and b not in done)
        if first:
            done.add(b)
        want[i, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first else lead[b]] += 1
    assert Counter(map(tuple, got)) == want


def test_archive_lookup(spark):
    pages, _ = pages_table(spark)
    folder = common.fresh_dir(spark, "warc")
    directory = archive.index(archive.write(archive.decide(pages), folder), folder, lines=2)
    asked = spark.createDataFrame([("http://b.example.com/x?q=1",), ("http://c.org/",), ("http://no.where/",), (None,)], "url string")
    found = archive.lookup(directory, asked).collect()
    assert Counter((r.asked, r.page_id) for r in found) == Counter([("http://b.example.com/x?q=1", 1), ("http://c.org/", 5), ("http://c.org/", 6), ("http://c.org/", 7)])
    assert archive.reversed_key("http://www.B.example.com:80/x?q=1") == "com,example,b)/x?q=1"


def test_archive_of_odd_ids_and_addresses(spark):
    big = "x" * 1200
    data = [(None, "http://a.example.com/", big), (None, None, "y"), (7, "http://[foo/", big), (8, "no\thost\nHere", "z")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = archive.round_trip(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type) for r in got) == Counter((i, len(h), "response") for i, _, h in data)
    folder = common.fresh_dir(spark, "warc")
    directory = archive.index(archive.write(archive.decide(pages), folder), folder, lines=2)
    found = archive.lookup(directory, pages.select("url")).collect()
    assert Counter((r.asked, r.page_id) for r in found) == Counter((u, i) for i, u, _ in data if u)


def test_revisits_name_the_record_they_refer_to(spark):
    pages, _ = pages_table(spark)
    heads = []
    for r in archive.decide(pages).collect():
        raw = archive.zlib.decompress(archive.capture(r.page_id, r.copy, r.url, bytes(r.payload), r.digest, r.refers_to, r.refers_copy), 31)
        heads.append(dict(line.split(": ", 1) for line in raw.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]))
    responses = {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert revisits and all(h["WARC-Refers-To"] in responses for h in revisits)


# --- bit slices


def test_top_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[50:60] = v[0]
    rows = [(int(i), x.tolist(), 1) for i, x in enumerate(v)] + [(900, None, 0), (901, [1.0, None] + [0.0] * 6, 0), (902, [float("nan")] * 8, 0), (903, [float("inf")] * 8, 0), (904, [], 0), (905, [1.0], 0)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("segment", T.IntegerType())])
    df = spark.createDataFrame(rows, schema)
    q = np.floor(1024 * v.astype(float)).astype(int)
    want = []
    for i in range(0, 400, 100):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(400), -s)) if j != i][:10]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(order)]
    assert sorted(map(tuple, bitslices.top_neighbours(df).collect())) == want
    small = bitslices.quantised(df.where("vec_id < 300"))
    got = bitslices.search(bitslices.build(small, segment_rows=64), small.where("vec_id = 0"), k=400, block=2)
    assert got.count() == 299
    assert bitslices.top_neighbours(df.where("vec_id = 0")).count() == 0
    assert bitslices.top_neighbours(df.where("vec_id > 990")).count() == 0


def test_vectors_of_unlike_lengths_and_large_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [3.0, 3.0]), (100, [1.0, 1.0, 1.0]), (101, [2.0, 0.5, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in bitslices.top_neighbours(df).collect()}
    one = 1024 * 1024
    assert got == {(0, 1): (2, 9 * one), (0, 2): (1, 4 * one), (100, 1): (101, int(3.5 * one))}
    with pytest.raises(OverflowError):
        bitslices.top_neighbours(spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2.0])], "vec_id long, embedding array<double>"))


# --- word pieces


def greedy(word, vocabulary):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


def test_automaton_equals_greedy():
    rng = random.Random(6)
    for _ in range(60):
        vocab = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9))}
        automaton = pieces.Automaton(vocab)
        for _ in range(60):
            w = bytes(rng.choice(b"abc") if rng.random() < 0.1 else rng.choice(b"ab") for _ in range(rng.randrange(0, 14)))
            assert automaton.count(w) == greedy(w, vocab)
    two = pieces.Automaton([b"un", b"a"], [b"aff", b"able", b"a"])
    assert two.count(b"unaffable") == 3 and two.count(b"affable") == 1


def test_token_counts(spark, rows):
    vocab = set(pieces.byte_strings(PATH))
    got = Counter(map(tuple, pieces.token_counts(table(spark, rows), PATH).collect()))
    want = Counter()
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        want[i, len(w), sum(greedy(x, vocab) for x in w)] += 1
    assert got == want


# --- language model


def test_language_model(spark, rows):
    got = pitman_yor.held_out_scores(table(spark, rows)).collect()
    assert len(got) == len(rows)
    train = Counter()
    for i, t, _ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*(t or "").encode().lower().split(), b" "])
    n, v = sum(train.values()), len(train)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append([*(t or "").encode().lower().split(), b" "])
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and r.train_tokens == n
        options = [(len(w), sum(x in train for x in w), round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for w in texts[r.doc_id]]
        assert (r.n_tokens, r.n_known, round(r.base_score, 6)) in options
        assert r.score < 0


def model_pairs(docs, coded=np.zeros(0, np.uint64)):
    """Pairs (context, word) of names in the texts, with counts."""
    out = Counter()
    for _, t, _ in docs:
        tokens, counts = pitman_yor._with_ends(pa.array([t or ""]), coded)
        out.update(zip(pitman_yor._contexts(tokens, counts).tolist(), tokens.tolist(), strict=True))
    return out


def opened(model):
    """The model as plain numbers: own[context, word], back[context] and p[word] by kept sweep, size[context]."""
    scalars = {"theta": model.theta, "d1": model.d1, "sizes": model.sizes, "places": model.places, "split_n": model.split_n, "splits": model.splits}
    own, back, size = {}, {}, {}
    for row in model.books.join(model.seating, F.col("shard") == F.col("place")).collect():
        r = pitman_yor.Restaurants(row.asDict(), scalars)
        several = len(r.words)
        ones = pitman_yor._array(row.ones, "<u4")
        of = np.concatenate([r.of, np.repeat(np.arange(len(r.contexts)), ones)])
        word = np.concatenate([r.words, pitman_yor._array(row.single, "<u8")])
        assert len(of) == len(word) == len(r.mass) and several <= len(word)
        own |= {(int(r.contexts[i]), int(w)): float(m) for i, w, m in zip(of, word, r.mass, strict=True)}
        back |= {int(c): b for c, b in zip(r.contexts, r.back, strict=True)}
        size |= {int(c): int(n) for c, n in zip(r.contexts, r.n, strict=True)}
    rows = model.words.toArrow()
    p = dict(zip(rows.column("word").to_numpy().view(np.uint64).tolist(), pitman_yor._word_values(model.parent, rows)[1], strict=True))

    def chance(context, word):
        b = back.get(context, np.ones(len(model.sizes)))
        return own.get((context, word), 0.0) / (1 + size.get(context, 0)) + float((b * p.get(word, np.array(model.shares))).mean())

    return own, size, p, chance


def some_texts():
    rng = random.Random(4)
    return [(i, " ".join(words(rng, 60, "u", 60)), "a") for i in range(60)] + [(60, "u1 u2 u1 u2 new u1 other", "a"), (61, None, "a"), (62, "hot " * 300, "a")]


def test_every_pair_counts_and_chances_sum_to_one(spark):
    texts = some_texts()[:60] + some_texts()[61:]
    for shard_bytes in (1 << 20, 1000):  # one shard; many, with contexts in several of them and short names
        model = pitman_yor.fit(table(spark, texts), sweeps=3, burn_in=1, shard_bytes=shard_bytes)
        assert (model.places.shards > 4) == bool(len(model.places.coded)) == (shard_bytes == 1000)
        pairs = model_pairs(texts, model.places.coded)
        own, size, p, chance = opened(model)
        assert set(own) == set(pairs) and all(c - model.d1 * c - 1e-6 <= own[k] <= c - model.d1 + 1e-6 for k, c in pairs.items())
        totals = Counter()
        for (u, _), c in pairs.items():
            totals[u] += c
        assert size == dict(totals)
        for u in list(totals)[:20]:
            assert sum(chance(u, w) for w in p) + chance(u, -1) == pytest.approx(1, abs=1e-9)
    assert max(model.places.parts, default=0) > 1
    got = pitman_yor.score(table(spark, some_texts()), model, near_words=8, near_pairs=20).collect()
    for r in got:
        want = sum(n * math.log10(chance(*k)) for k, n in model_pairs([some_texts()[r.doc_id]], model.places.coded).items())
        assert r.score == pytest.approx(want, rel=1e-5)


def test_scores_do_not_depend_on_partitions_or_broadcasts(spark):
    docs = table(spark, some_texts())
    seen = []
    for parts, near in ((1, 1000), (8, 1000), (60, 3)):
        model = pitman_yor.fit(docs.repartition(parts).where("doc_id % 5 <> 1"), shard_bytes=2000)
        seen.append({r.doc_id: (r.score, r.base_score, r.n_known) for r in pitman_yor.score(docs.repartition(parts), model, near_words=near, near_pairs=near).collect()})
    for other in seen[1:]:
        for i, values in seen[0].items():
            assert other[i] == pytest.approx(values, rel=1e-5)


def test_seating():
    rng = np.random.default_rng(0)

    def slow(c, strength, d):
        t = 0
        for k in range(c):
            t += t == 0 or rng.random() * (strength(t) + k - d * t) < strength(t)
        return t

    # a parent with fixed other tables: the strength is (theta + d * (others + t)) / (v + 1)
    for c in (2, 12, 300):
        names = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
        prior = pitman_yor.Own(np.full(4000, 40.0), 1.0, 0.5, 9)
        fast = pitman_yor.reseated(np.full(4000, c), names, prior, 0.5, 0, 1)
        assert fast.min() >= 1 and fast.max() <= c
        if c > pitman_yor.EXACT:
            assert fast.mean() == pytest.approx(np.mean([slow(c, lambda t: (1 + 0.5 * (40 + t)) / 10, 0.5) for _ in range(1500)]), rel=0.05)
        else:
            logs = [pitman_yor.log_stirling(0.5)[c, t] + sum(math.log((1 + 0.5 * (40 + i)) / 10) for i in range(1, t)) for t in range(1, c + 1)]
            weights = np.exp(np.array(logs) - max(logs))
            assert fast.mean() == pytest.approx((weights / weights.sum() * np.arange(1, c + 1)).sum(), rel=0.05)
    mixed_sizes = pitman_yor.reseated(np.array([0, 1, 2000, 3]), np.arange(4, dtype=np.uint64), pitman_yor.Own(np.full(4, 5.0), 1.0, 0.5, 9), 0.5, 0, 1)
    assert mixed_sizes[0] == 0 and mixed_sizes[1] == 1 and 1 < mixed_sizes[2] < 2000


def test_model_without_training_rows(spark, rows):
    docs = table(spark, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 1])
    assert all(r.train_tokens == 0 and r.score == 0 for r in pitman_yor.held_out_scores(docs).collect())


def plain_restaurants(texts, sweeps, burn_in, d0, d1, rng):
    """A Chinese-restaurant sampler customer by customer; mean probability of each pair (context, word) of known words."""
    pairs = model_pairs(texts)
    vocabulary = sorted({w for _, w in pairs})
    v, tables, parent = len(vocabulary), {k: [] for k in pairs}, {w: [] for w in vocabulary}
    guests = [k for k, c in pairs.items() for _ in range(c)]

    def parent_p(w):
        t, n = sum(map(len, parent.values())), sum(map(sum, parent.values()))
        return (sum(parent[w]) - d0 * len(parent[w]) + (1 + d0 * t) / (v + 1)) / (1 + n)

    def context_tables(u):
        return sum(len(x) for (a, _), x in tables.items() if a == u)

    def sit(at, d, new):
        weights = [x - d for x in at] + [new]
        i = rng.choices(range(len(weights)), weights)[0]
        if i == len(at):
            at.append(0)
        at[i] += 1
        return i == len(at) - 1 and at[i] == 1

    def leave(at):
        i = rng.choices(range(len(at)), at)[0]
        at[i] -= 1
        if not at[i]:
            at.pop(i)
            return True
        return False

    totals, mean = Counter(), Counter()
    for (u, _), c in pairs.items():
        totals[u] += c
    for sweep in range(sweeps):
        for u, w in guests:
            if sweep and leave(tables[u, w]):
                leave(parent[w])
            if sit(tables[u, w], d1, (1 + d1 * context_tables(u)) * parent_p(w)):
                t = sum(map(len, parent.values()))
                sit(parent[w], d0, (1 + d0 * t) / (v + 1))
        if sweep >= burn_in:
            p = {w: parent_p(w) for w in vocabulary}
            for u in totals:
                back = (1 + d1 * context_tables(u)) / (1 + totals[u])
                for w in vocabulary:
                    mean[u, w] += ((pairs.get((u, w), 0) - d1 * len(tables.get((u, w), []))) / (1 + totals[u]) + back * p[w]) / (sweeps - burn_in)
    return mean


def test_contexts_and_parent_share_sweeps(spark):
    # "only" follows one word alone, the others follow any
    draw = random.Random(6)
    texts = [(i, "see only see only " + " ".join(draw.choice("abcdef") for _ in range(12)), "a") for i in range(6)]
    model = pitman_yor.fit(table(spark, texts), sweeps=14, burn_in=4)
    want = plain_restaurants(texts, 400, 50, model.d0, model.d1, random.Random(1))
    chance = opened(model)[3]
    assert max(abs(math.log(chance(*k) / want[k])) for k in want) < 0.25


def test_single_words_do_not_inflate_the_parent(spark):
    # mostly words that occur once: the parent's discount is large
    draw = random.Random(7)
    texts = [(i, " ".join([f"one{i}x{j}" for j in range(8)] + [draw.choice("ab") for _ in range(4)]), "a") for i in range(8)]
    model = pitman_yor.fit(table(spark, texts), sweeps=14, burn_in=4)
    want = plain_restaurants(texts, 200, 50, model.d0, model.d1, random.Random(1))
    chance = opened(model)[3]
    assert model.d0 > 0.8 and max(abs(math.log(chance(*k) / want[k])) for k in want) < 0.7


# --- quality rules


def test_quality_rules(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        w = words(rng, 50)
        docs.append((i, " ".join(w if good else [x + "###" for x in w]), "a"))
        labels.append((i, int(good), 0))
    docs += [(600, None, "a"), (601, "", "a"), (0, docs[0][1], "a")]
    labels += [(0, labels[0][1], 0), (5, None, 0), (None, 1, 0)]
    label_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rules.quality(table(spark, docs), label_df).collect()
    assert len(got) == len(docs)
    truth = dict((i, q) for i, q, _ in labels[:600])
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id < 600 and r.held_out)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    kept = rules.accepted(table(spark, docs), label_df)
    assert {r.doc_id for r in kept.collect()} - {600, 601} == {i for i, q in truth.items() if q}
    one = rules.quality(table(spark, docs), label_df.where("quality = 1"))
    assert len({r.score for r in one.collect()}) == 1


def test_tree_rules():
    text = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 1.0\n   Else (feature 1 > 2.0)\n    Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 0.0\n"
    assert rules.tree_rules(text, ["a", "b"]) == [(("a", "<=", 1.5),), (("a", "<=", 1.5), ("b", "<=", 2.0)), (("a", "<=", 1.5), ("b", ">", 2.0)), (("a", ">", 1.5),)]


# --- language


def test_language(spark):
    rng = random.Random(2)
    speak = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "nicht", "über"], "fr": ["le", "et", "être", "été"]}
    texts = [(i, " ".join(rng.choice(speak[x]) for _ in range(40)), x, f"s{i % 3}", 0) for i, x in enumerate(["en", "de", "fr"] * 40)]
    docs = spark.createDataFrame([*texts, (900, None, "en", "s0", 0), (901, "12 34 !!", None, None, 0), texts[0], (902, "漢字漢字漢字 漢字漢字漢字", None, "s1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in language.identified_documents(docs).collect()]
    assert Counter(kept) == Counter([t[0] for t in texts] + [0, 900])
    html = '<html lang="{}"><script>the and the and</script><body>{}</body></html>'
    pages = [(i, f"http://h.{x}.example.org/{i}", html.format(x, " ".join(rng.choice(speak[x]) for _ in range(12))), "k") for i, x in enumerate(["en", "de", "fr"] * 10)]
    pages += [(90, "http://h.de.example.org/", html.format("de", ""), "k"), (91, None, None, "k"), (92, "http://x", "<html>der und nicht über der</html>", "k")]
    got = {r.page_id: r for r in language.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string, host string"), docs).collect()}
    assert [got[i].lang for i in range(30)] == ["en", "de", "fr"] * 10
    assert got[90].lang == "de" and got[91].lang == "und" and got[92].lang == "de"


def test_languages_of_few_rows(spark):
    rng = random.Random(5)
    speak = {"en": ["the", "and", "thing", "with"], "el": ["και", "του", "είναι", "αυτό"]}
    texts = [(i, " ".join(rng.choice(speak[x]) for _ in range(30)), x, "s", 0) for i, x in enumerate(["en"] * 2995 + ["el"] * 5)]
    texts += [(5000, "漢字漢字漢字 漢字漢字漢字", "zh", "s", 0), (5001, "漢字漢字漢字 漢字漢字漢字", None, "s", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in language.identified_documents(docs).collect()}
    # one labelled row makes a model: the same text without a label is known by it
    assert kept == {t[0] for t in texts}
    page = [(1, None, f'<html data-x="{"y" * 900}" lang="el"><body>12</body></html>'), (2, None, "<html><body>και του είναι αυτό και του</body></html>")]
    pages = spark.createDataFrame(page, "page_id long, url string, html string")
    assert {r.page_id: r.declared for r in language.page_rows(pages).collect()} == {1: "el", 2: None}
    assert {r.page_id: r.lang for r in language.identify_pages(pages, docs).collect()}[2] == "el"


def test_stages_keep_clashing_columns(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["the", "and", "thing", "with"]) for _ in range(40)), "en", "s", 0) for i in range(40)]
    odd = ["t", "w", "l", "_key", "_score", "_once", "row", "_times", "x_words", "name"]
    docs = spark.createDataFrame([(*t, *map(str, range(len(odd)))) for t in texts], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{c} string' for c in odd)}")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for out in (language.identified_documents(docs), rules.accepted(docs, labels), ngram_join.first_of_each(docs), mixing.mixed_documents(docs)):
        assert out.columns == docs.columns and out.count() > 0
        assert all(tuple(r)[5:] == tuple(map(str, range(len(odd)))) for r in out.collect())


def test_compiled_rules_equal_plain_evaluation(spark):
    rows = [("a b, c. D", 0), ("", 1), (None, 1), ("x " * 50 + "!!! |||", 0), ("One two\nthree four.", 1)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = (0.3, [((("words", "<=", 2.0),), 1.5), ((("commas", ">", 0.1), ("words", ">", 0.5)), -0.7), ((("shouts", ">", 0.0),), -2.0)])
    stats = rules.with_statistics(docs, "doc_id")
    got = {r.doc_id: r.score for r in stats.select("doc_id", rules.compiled(model).alias("score")).collect()}
    for r in stats.collect():
        total = model[0] + sum(w for rule, w in model[1] if all((r[f"x_{n}"] <= v) if s == "<=" else (r[f"x_{n}"] > v) for n, s, v in rule))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-12)


# --- shared helpers and empty tables


def test_words(spark):
    texts = [None, "", " a\tB\x0b\x0cc\r\nd ", " x y\x1cz", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = [r[0] for r in df.select(common.word_count(F.col("text"))).collect()]
    flat, per = common.words_of(pa.array(texts))
    assert counts == per.tolist() == [0, 0, 4, 1, 1] and flat[:4] == [b"a", b"b", b"c", b"d"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert packing.pack(none, PATH).count() == mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
    assert fingerprints.edited_fingerprints(none).count() == ngram_join.linked(none).count() == ngram_join.first_of_each(none).count() == 0
    assert pieces.token_counts(none, PATH).count() == pitman_yor.held_out_scores(none).count() == 0
    assert rules.quality(none, labels).count() == rules.accepted(none, labels).count() == language.identified_documents(none).count() == 0
    assert archive.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert bitslices.top_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_words_by_bytes():
    """Words cut by arrays of bytes are those cut one by one, in any slice of the array."""
    draw = random.Random(5)
    letters = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "a", "B", "Z", "é", "İ", "\x1c", "\x85", "\u2003", "x"]
    for trial in range(500):
        texts = [None if draw.random() < 0.1 else "".join(draw.choices(letters, k=draw.randint(0, 8))) for _ in range(draw.randint(0, 6))]
        rows = pa.array(texts, pa.string())[trial % 3 :]
        flat, per = common.words_of(rows)
        words, counts = common.word_array(rows)
        assert words.to_pylist() == flat and counts.tolist() == per.tolist()
        hashes, which, again = common.coded_words(rows)
        assert hashes[which].tolist() == common.hashes_of(flat).tolist() and again.tolist() == per.tolist()
