"""Language evidence against a plain posterior, many rare languages, several passes."""

import math
import random
from collections import Counter

import pytest

from timegrid.llm import language as X

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def pairs(text):
    b = b" " + (text or "").encode().translate(X.LETTERS) + b" "
    return [p for p in zip(b, b[1:]) if p != (32, 32)] if text else []


class Plain:
    """The model by counting one pair at a time."""

    def __init__(self, rows):
        self.c, whole = {}, Counter()
        for text, lang in rows:
            if lang is not None:
                own = Counter(pairs(text))
                self.c.setdefault(lang, Counter()).update(own)
                whole.update(own)
        self.langs, self.n = sorted(self.c), sum(whole.values())
        self.pool = lambda p: (whole[p] + 0.5) / (self.n + 0.5 * (len(whole) + 1))
        total = sum(c * math.log(self.chance(x, p)) for x in self.langs for p, c in self.c[x].items())
        self.own = total / max(1, self.n) if self.n else 0.0

    def chance(self, lang, p):
        n = max(1, sum(self.c[lang].values()))
        q = (X.POOLED + X.QUOTED * n) / (X.POOLED + n)
        return (1 - q) * self.c[lang][p] / n + q * self.pool(p)

    def likelihood(self, text):
        own = pairs(text)
        return [X.TEMPER * sum(math.log(self.chance(x, p)) for p in own) for x in self.langs] + [X.TEMPER * len(own) * (self.own - X.MARGIN)]


def posterior(model, rows):
    """lang of each row (text, declared, suffix, domain, host), by the definitions."""
    outcomes = [*model.langs, "und"]
    lls = [model.likelihood(r[0]) for r in rows]
    best = [outcomes[max(range(len(ll)), key=lambda i: (ll[i], -i))] if pairs(r[0]) else None for ll, r in zip(lls, rows)]
    totals = Counter(x for x in best if x)
    out = []
    for i, (r, ll) in enumerate(zip(rows, lls)):
        def votes(k, lang=None):
            return sum(b is not None and o[k] == r[k] and r[k] is not None and j != i and lang in (None, b) for j, (o, b) in enumerate(zip(rows, best)))

        scores = []
        for x, l in zip(outcomes, ll):
            prior = (totals[x] + 1) / (sum(totals.values()) + len(outcomes))
            for k in (3, 4):
                prior = (votes(k, x) + X.SMOOTHING * prior) / (votes(k) + X.SMOOTHING)
            l += math.log(prior)
            for k in (1, 2):
                if r[k] is not None:
                    l += math.log((votes(k, x) + 0.5) / (totals[x] + 0.5 * (len(outcomes) + 1)))
            scores.append(l)
        top = max(scores)
        silent = not pairs(r[0]) and r[1] is None and r[4] is None
        out.append(("und", 0.0) if silent else (outcomes[scores.index(top)], 1 / sum(math.exp(s - top) for s in scores)))
    return out


def some():
    rng = random.Random(6)
    speak = {"en": "the and thing with of to".split(), "de": "der und nicht über von zu".split(), "fr": "le et être été de à".split(), "qq": ["zqx", "xqz"]}
    train = [(" ".join(rng.choice(speak[x]) for _ in range(rng.randrange(1, 50))), x) for x in ["en", "de", "fr"] * 12] + [("zqx xqz zqx", "qq"), (None, "en"), ("", "none"), ("abc", None)]
    rows = []
    for i in range(60):
        x = rng.choice(list(speak))
        text = rng.choice([None, "", "12 !", " ".join(rng.choice(speak[x]) for _ in range(rng.randrange(1, 12)))])
        rows.append((text, rng.choice([None, x, "de"]), rng.choice([None, "com", x]), rng.choice([None, "a.b", "c.d"]), None))
        rows[-1] = (*rows[-1][:4], rows[-1][3] and rng.choice(["x", "y"]) + rows[-1][3])
    return train, rows


@pytest.mark.parametrize("part", [X.PART_CELLS, 30])
def test_equals_plain_posterior(spark, part):
    train, rows = some()
    model = X.train(spark.createDataFrame(train, "text string, lang string").repartition(3), part)
    plain = Plain(train)
    assert model.langs == plain.langs and model.own == pytest.approx(plain.own) and (len(model.parts) > 1) == (part == 30)
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, declared string, suffix string, domain string, host string").repartition(2)
    for r in X.likelihoods(table.select("id", "text"), model).collect():
        assert list(r["ll"]) == pytest.approx(plain.likelihood(rows[r["id"]][0]), rel=1e-5, abs=1e-6) and r["n_pairs"] == len(pairs(rows[r["id"]][0]))
    got = {r["id"]: (r["lang"], r["confidence"]) for r in X.identify(table, model).collect()}
    for i, (lang, confidence) in enumerate(posterior(plain, rows)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(confidence, rel=1e-3), rows[i]


def test_a_language_of_one_row(spark):
    train, _ = some()
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, (t, x) in enumerate(train)], DOCS)
    pages = spark.createDataFrame([(1, None, "<p>xqz zqx xqz</p>"), (2, None, "<p>the thing with the</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.lang for r in X.identify_pages(pages, docs).collect()} == {1: "qq", 2: "en"}


def test_a_thousand_codes(spark):
    rng = random.Random(1)
    train, _ = some()
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = [(" ".join("".join(rng.choices(letters, k=5)) for _ in range(8)), f"x{k:03}") for k in range(1000) for _ in range(rng.randrange(1, 4))]
    model = X.train(spark.createDataFrame(train + rare, "text string, lang string").repartition(4), 20_000)
    assert len(model.langs) == 1005 and len(model.parts) > 2
    # no part holds more than its bound, whatever the number of languages
    assert max(len(model.part(p)[1]) for p in model.parts[:3]) <= 20_000
    texts = [("the thing with the and of to the", "en"), ("der und nicht über von der und", "de")]
    got = X.identify(spark.createDataFrame([(i, t, None, None, None, None) for i, (t, _) in enumerate(texts)], "id long, text string, declared string, suffix string, domain string, host string"), model).collect()
    assert {r["id"]: r["lang"] for r in got} == {0: "en", 1: "de"}
