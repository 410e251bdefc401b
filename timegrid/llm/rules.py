"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on labelled texts' statistics; the path to every node is a rule, a conjunction of thresholds.
A logistic regression with an L1 penalty weighs the rules, most to zero. The rest is compiled into one Spark column
expression, so scoring is a scan with no join, shuffle or Python.

Labelled rows: at most `sample` of them in expectation (chosen by a hash of doc_id, each with the same chance) are
joined to their texts; texts are only read for these. All other work covers every document.

Defined cases: null texts count as empty; an empty text has all statistics 0 and a score; labels that are null don't
count, of repeated labels of a document the smallest does; without labels of both kinds every score is the smoothed
share of label 1; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import BLANKS, save

SAMPLE = 20_000
PARTS = 6
TREES = 24
DEPTH = 3
PENALTY = 0.001
ACCEPT = 0.3
Rule = tuple[tuple[str, str, float], ...]

#: Statistics of a text t, its words w and lines l; shares are of characters, words or lines.
STATISTICS = {
    "words": "ln(1 + size(w))",
    "word_length": "least(50D, length(t) / greatest(1, size(w)))",
    "upper": "length(regexp_replace(t, '[^\\\\p{Lu}]+', '')) / greatest(1, length(t))",
    "marks": "length(regexp_replace(t, '[^#$%&*|!@^~<>{}=_+\\\\\\\\/-]+', '')) / greatest(1, length(t))",
    "bars": "(length(t) - length(replace(t, '|', ''))) / greatest(1, size(w))",
    "shouts": "(length(t) - length(replace(t, '!', ''))) / greatest(1, size(w))",
    "commas": "(length(t) - length(replace(t, ',', ''))) / greatest(1, size(w))",
    "stops": "(length(t) - length(replace(t, '.', ''))) / greatest(1, size(w))",
    "digits": "length(regexp_replace(t, '[^0-9]+', '')) / greatest(1, length(t))",
    "distinct": "size(array_distinct(w)) / greatest(1, size(w))",
    "stutter": "if(size(w) < 2, 0, size(filter(sequence(1, greatest(1, size(w) - 1)), i -> w[i] = w[i - 1]))) / greatest(1, size(w))",
    "line_words": "least(200D, size(w) / greatest(1, size(l)))",
    "lines_distinct": "size(array_distinct(l)) / greatest(1, size(l))",
}


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of docs and the statistics of text, as doubles."""
    t = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumn("w", F.filter(F.split("t", BLANKS), lambda x: x != "")).withColumn("l", F.split("t", "\n"))
    return t.select(*keep, *(F.expr(e).cast("double").alias(f"x_{n}") for n, e in STATISTICS.items()))


def tree_rules(description: str, names: list[str]) -> list[Rule]:
    """The paths to all nodes of a tree, from its printed form; of two bounds on one side the tighter stays."""
    rules, path = [], []
    for line in description.splitlines():
        if not (m := re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)):
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, names[int(m[3])], m[4], float(m[5]))]
        bounds: dict[tuple[str, str], float] = {}
        for _, name, side, value in path:
            best = min if side == "<=" else max
            bounds[name, side] = best(value, bounds.get((name, side), value))
        rules.append(tuple(sorted((n, s, v) for (n, s), v in bounds.items())))
    return rules


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"x_{n}") <= v if s == "<=" else F.col(f"x_{n}") > v for n, s, v in rule))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 3) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from texts whose doc_id has a label (columns doc_id, label of 0 or 1)."""
    labels = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    count = labels.count()
    chance = min(1.0, sample / max(1, count))
    chosen = labels.where(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 20)) < int(chance * (1 << 20)))
    # the sample's size is bounded, so its ids may go to all executors: texts are filtered where they lie
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = save(with_statistics(texts, "label"), "statistics")
    names = list(STATISTICS)
    ones, n = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    ones = int(ones or 0)
    prior = math.log((ones + 1) / (n - ones + 1))
    if ones in (0, n):
        return prior, []
    features = array_to_vector(F.array(*(f"x_{n}" for n in names)))
    # the sample has a bounded size: a few partitions, or else the fits' many small jobs are mostly task overhead
    data = rows.coalesce(PARTS).select(F.col("label").cast("double").alias("label"), features.alias("features"), *(f"x_{n}" for n in names)).persist()
    try:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=48, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed).fit(data)
        rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString, names)})
        if not rules:
            return prior, []
        hits = data.select("label", array_to_vector(F.array(*(holds(r).cast("double") for r in rules))).alias("features"))
        fit = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=80, standardization=True).fit(hits)
    finally:
        data.unpersist()
    weights = fit.coefficients.toArray().tolist()
    return float(fit.intercept), [(r, w) for r, w in zip(rules, weights, strict=True) if w]


def compiled(model: tuple[float, list[tuple[Rule, float]]]) -> Column:
    """The model's probability of label 1, as an expression over the statistics."""
    intercept, rules = model
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, accept: float = ACCEPT) -> DataFrame:
    """Scores every document, learning from labels outside the fold: doc_id, held_out, score, predicted."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))
    model = train(docs, labels.where(~held).select("doc_id", F.col("quality").alias("label")))
    scored = with_statistics(docs, "doc_id").select("doc_id", held.alias("held_out"), compiled(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents whose score reaches `accept`, with all their columns."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = train(docs, labels.where(~held).select("doc_id", F.col("quality").alias("label")))
    # the documents' own columns go along in one, so none of their names can clash
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    scored = with_statistics(own, "row").select("row", compiled(model).alias("_score"))
    # a plain filter would be pushed below the statistics, with a copy of them for every rule; a generator isn't
    once = F.when(F.col("_score") >= accept, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return scored.withColumn("_once", F.explode(once)).select("row.*")
