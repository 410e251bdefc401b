"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of
- the text's likelihood: byte pairs of its letters, each language's chances mixed with the pool's, the more so the less
  there is of it; tempered because neighbouring pairs tell the same twice,
- the chance of the language that the markup declares, given the language,
- the chance of the address's suffix, given the language,
- the host's prior, smoothed towards its domain's, and that towards the corpus's.
The pair table is trained on labelled texts by grouped counts; the other tables are grouped counts of what the texts
alone say, less the row itself, so a row is no evidence for itself.

A further outcome, `und`, has a likelihood a fixed margin below what texts of their own language have on average.

Every language that labels a row has a model. A pair that a language doesn't have adds the same for all, the pool's
chance, so a model is a list of its own pairs. Lists of at most PART_CELLS pairs in all are sent out at a time; languages
beyond that are scored in further passes over the texts.

Defined cases: null, empty and letterless texts have no likelihood to add; if there is no other evidence either they
are `und`. A null declaration, suffix or host is a value of its own without effect. Repeated rows count each. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timegrid.llm.common import save, slices

CELLS = 1 << 16
#: Pairs of the languages that one pass scores, 12 bytes each.
PART_CELLS = 2_000_000
#: A language's chances count as those of so many pairs of the pool more.
POOLED = 200.0
TEMPER = 0.2
MARGIN = 3.0
QUOTED = 0.1
SMOOTHING = 4.0
#: A host's domain: its last two labels, or three where these are two letters after at most three, as in co.uk.
DOMAIN = r"([^.]+\.[^.]{1,3}\.[a-z]{2}|[^.]+\.[^.]+)$"
#: A-Z lowered, other ASCII that is no letter as a blank, further bytes as they are.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pairs(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of byte pairs that aren't two blanks, text after text, and how many each text has."""
    cells, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            a = np.frombuffer(b" " + text.translate(LETTERS) + b" ", np.uint8)
            pair = a[:-1].astype(np.int32) * 256 + a[1:]
            pair = pair[pair != 32 * 257]
            counts[i] = len(pair)
            cells.append(pair)
    return np.concatenate([np.empty(0, np.int32), *cells]), counts


@dataclass
class Model:
    """counts: lang, cell, c, n. own: mean log chance of a training pair in its language.

    log_pool: of each cell. n: pairs by language, in the order of langs. parts: the languages of each pass.
    """

    langs: list[str]
    n: np.ndarray
    log_pool: np.ndarray
    own: float
    counts: DataFrame
    parts: list[range]

    def shares(self) -> np.ndarray:
        """The pool's share in each language's chances."""
        return (POOLED + QUOTED * self.n) / (POOLED + self.n)

    def part(self, langs: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By cell where its entries begin, and of each entry the language and what it adds to the log chance."""
        names = self.langs[langs.start : langs.stop]
        own = self.counts.where(F.col("lang").isin(names)).select("lang", "cell", "c").toArrow()
        number = {x: langs.start + i for i, x in enumerate(names)}
        lang = np.array([number[x] for x in own.column("lang").to_pylist()], np.int32)
        cell, c = own.column("cell").to_numpy(), own.column("c").to_numpy().astype(float)
        up = np.lexsort((lang, cell))
        lang, cell, c = lang[up], cell[up], c[up]
        q = self.shares()[lang]
        gain = np.log1p((1 - q) * c / self.n[lang] / (q * np.exp(self.log_pool[cell])))
        return np.searchsorted(cell, np.arange(CELLS + 1)), lang, gain.astype(np.float32)


def train(texts: DataFrame, part_cells: int = PART_CELLS) -> Model:
    """The model of rows of text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                langs = part.column("lang").dictionary_encode()
                cells, counts = _pairs(part.column("text").cast(pa.binary()).to_pylist())
                of = np.repeat(langs.indices.to_numpy().astype(np.int64), counts)
                found, c = np.unique(of * CELLS + cells, return_counts=True)
                # a row without pairs still makes its language known
                names = langs.dictionary
                lang = pa.concat_arrays([names.take(pa.array(found // CELLS)), names])
                yield pa.record_batch({"lang": lang, "cell": pa.array(np.append(found % CELLS, np.full(len(names), -1)), pa.int32()), "c": pa.array(np.append(c, np.zeros(len(names), np.int64)))})

    counts = texts.where("lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, cell int, c long").groupBy("lang", "cell").agg(F.sum("c").alias("c"))
    counts = save(counts, "pairs")
    sizes = sorted(((r["lang"], r["n"], r["cells"]) for r in counts.groupBy("lang").agg(F.sum("c").alias("n"), F.count_if(F.col("cell") >= 0).alias("cells")).collect()))
    whole = np.zeros(CELLS)
    for r in counts.where("cell >= 0").groupBy("cell").agg(F.sum("c").alias("c")).collect():  # 65,536 at most
        whole[r["cell"]] = r["c"]
    used = int((whole > 0).sum())
    log_pool = np.log((whole + 0.5) / (whole.sum() + 0.5 * (used + 1)))
    counts = counts.where("cell >= 0")
    model = Model([x for x, _, _ in sizes], np.array([max(1, n) for _, n, _ in sizes], float), log_pool, 0.0, counts, [])
    start = cells = 0
    for i, (_, _, more) in enumerate(sizes):
        if i > start and cells + more > part_cells:
            model.parts.append(range(start, i))
            start, cells = i, 0
        cells += more
    model.parts.append(range(start, len(sizes)))
    n = F.sum("c").over(Window.partitionBy("lang"))
    q = (POOLED + QUOTED * n) / (POOLED + n)
    pool = F.sum("c").over(Window.partitionBy("cell"))
    chance = (1 - q) * F.col("c") / n + q * (pool + 0.5) / (float(whole.sum()) + 0.5 * (used + 1))
    model.own = counts.select("c", F.log(chance).alias("l")).agg(F.try_divide(F.sum(F.col("c") * F.col("l")), F.sum("c"))).first()[0] or 0.0
    return model


def likelihoods(rows: DataFrame, model: Model, temper: float = TEMPER) -> DataFrame:
    """rows (id columns and text) without text, with n_pairs and ll, the tempered log likelihood by language, `und` last."""
    spark, keep = rows.sparkSession, [c for c in rows.columns if c != "text"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields} | {"_before": "array<double>"}
    log_pool, log_share, end = model.log_pool, np.log(model.shares()), model.own - MARGIN

    def scorer(langs: range, given, carried: list[str], last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, lang, gain = given.value
            width = len(langs) + last
            for batch in batches:
                for part in slices(batch, most=1 << 20):
                    cells, counts = _pairs(part.column("text").cast(pa.binary()).to_pylist())
                    pairs, times = np.unique(np.repeat(np.arange(len(counts)), counts) * CELLS + cells, return_counts=True)
                    text, cell = pairs // CELLS, pairs % CELLS
                    base = np.bincount(text, log_pool[cell] * times, len(counts))
                    # all entries of each pair: its place in the lists is first[cell], first[cell] + 1, ...
                    many = first[cell + 1] - first[cell]
                    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first[cell], many)
                    place = np.repeat(text, many) * width + lang[at] - langs.start
                    sums = np.bincount(place, gain[at] * np.repeat(times, many), len(counts) * width).astype(float).reshape(-1, width)
                    sums[:, : len(langs)] += base[:, None] + counts[:, None] * log_share[langs.start : langs.stop]
                    if last:
                        sums[:, -1] = counts * end
                    ll = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * width), pa.array(sums.ravel() * temper))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(counts), ll], [*carried, "n_pairs", "ll"])

        return run

    for i, langs in enumerate(model.parts):
        last = i == len(model.parts) - 1
        carried = [*keep, *(["_before"] if i else []), *([] if last else ["text"])]
        given = spark.sparkContext.broadcast(model.part(langs))
        schema = ", ".join([*(f"`{c}` {types[c]}" for c in carried), "n_pairs long, ll array<double>"])
        found = rows.select(*keep, *(["_before"] if i else []), "text").mapInArrow(scorer(langs, given, carried, last), schema)
        ll = F.concat("_before", "ll") if i else F.col("ll")
        if last:
            return found.select(*keep, "n_pairs", ll.alias("ll"))
        rows = save(found.select(*keep, "text", ll.alias("_before")), "part")
        given.destroy()


def identify(rows: DataFrame, model: Model, smoothing: float = SMOOTHING) -> DataFrame:
    """rows (id columns, text, declared, suffix, domain, host) -> id columns, lang, confidence, text_lang, n_pairs.

    Counts by host are summed before they are shuffled, and joined back by value: hosts that hold a large part of the
    rows are skewed keys of plain joins, which adaptive execution splits.
    """
    outcomes = [*model.langs, "und"]
    names = F.array(*map(F.lit, outcomes))
    ids = [c for c in rows.columns if c not in ("text", "declared", "suffix", "domain", "host")]
    ll = save(likelihoods(rows, model), "likelihoods")
    best = F.array_position("ll", F.array_max("ll")).cast("int")
    ll = ll.withColumn("text_lang", F.when(F.col("n_pairs") > 0, F.element_at(names, best)).otherwise(F.lit(None).cast("string")))
    sure = ll.where("text_lang IS NOT NULL")

    def counts(key: str) -> DataFrame:
        c = sure.where(F.col(key).isNotNull()).groupBy(key, "text_lang").agg(F.count(F.lit(1)).cast("double").alias("c"))
        return c.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("text_lang", "c"))).alias(f"m_{key}"), F.sum("c").alias(f"n_{key}"))

    for key in ("declared", "suffix", "domain", "host"):
        ll = ll.join(counts(key), key, "left")
    totals = {r["text_lang"]: float(r["count"]) for r in sure.groupBy("text_lang").count().collect()}
    everything = sum(totals.values())
    corpus = F.array(*(F.lit((totals.get(x, 0.0) + 1) / (everything + len(outcomes))) for x in outcomes))
    number = F.array(*(F.lit(totals.get(x, 0.0)) for x in outcomes))

    def of(key: str, lang: Column) -> Column:
        """Rows of this key and language but for the row itself."""
        c = F.coalesce(F.try_element_at(F.col(f"m_{key}"), lang), F.lit(0.0))
        return F.greatest(F.lit(0.0), c - F.when(lang == F.col("text_lang"), 1.0).otherwise(0.0))

    def n(key: str) -> Column:
        return F.greatest(F.lit(0.0), F.coalesce(F.col(f"n_{key}"), F.lit(0.0)) - F.when(F.col("text_lang").isNotNull(), 1.0).otherwise(0.0))

    def log_posterior(i: Column) -> Column:
        lang, whole = F.get(names, i), F.get(number, i)
        prior = F.get(corpus, i)
        for key in ("domain", "host"):  # from the corpus down to the host, each smoothed to the one above
            prior = (of(key, lang) + smoothing * prior) / (n(key) + smoothing)
        declared = F.when(F.col("declared").isNull(), F.lit(0.0)).otherwise(F.log((of("declared", lang) + 0.5) / (whole + 0.5 * (len(outcomes) + 1))))
        suffix = F.when(F.col("suffix").isNull(), F.lit(0.0)).otherwise(F.log((of("suffix", lang) + 0.5) / (whole + 0.5 * (len(outcomes) + 1))))
        return F.get("ll", i) + declared + suffix + F.log(prior)

    scores = F.transform(F.sequence(F.lit(0), F.lit(len(outcomes) - 1)), log_posterior)
    out = ll.withColumn("s", scores).withColumn("top", F.array_max("s"))
    mass = F.aggregate(F.transform("s", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    silent = (F.col("n_pairs") == 0) & F.col("declared").isNull() & F.col("host").isNull()
    lang = F.when(silent, F.lit("und")).otherwise(F.element_at(names, F.array_position("s", F.col("top")).cast("int")))
    return out.select(*ids, lang.alias("lang"), F.when(silent, F.lit(0.0)).otherwise(1 / mass).alias("confidence"), "text_lang", "n_pairs")


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, the page's visible text, and its evidence columns."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|aside)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))

    def none(c: Column) -> Column:
        return F.when(c != "", c)

    return pages.select(
        "page_id", text.alias("text"), none(declared).alias("declared"), none(F.regexp_extract(host, r"\.([a-z]{2,})$", 1)).alias("suffix"),
        none(F.regexp_extract(host, DOMAIN, 1)).alias("domain"), none(host).alias("host"),
    )


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang, n_pairs of every page; labelled: texts with lang to train on."""
    return identify(page_rows(pages), train(labelled))


def identified_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is known: their `lang` counts as the declaration, their source as the host.

    Rejected are those whose most likely outcome is `und`. The columns stay as they are.
    """
    null, key = F.lit(None).cast("string"), F.xxhash64("doc_id", "text", "lang", "source")
    rows = docs.select(key.alias("_key"), "text", F.col("lang").alias("declared"), null.alias("suffix"), null.alias("domain"), F.col("source").alias("host"))
    unknown = save(identify(rows, train(docs)).where("lang = 'und'").select("_key").distinct(), "unknown")
    # the documents' own columns go along in one, so none of their names can clash
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("_key")).join(unknown, "_key", "left_anti")
    return kept.select("row.*")
