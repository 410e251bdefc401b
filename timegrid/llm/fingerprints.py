"""Canonical exact digests of documents.

A text's canonical form: NFKC, full case folding, NFKC again, then every run of white space or control characters is
one blank, none at the ends. Its fingerprint is 128 bits of xxhash as hexadecimal. Texts are grouped by these; inside
a group of equal fingerprints the canonical bytes are compared, and where they differ (a collision) the fingerprints
get the texts' SHA-256 appended, so equal fingerprints mean equal canonical texts. Digests of edited texts are compared
with all others by the SHA-256 of their canonical forms.

Only DataFrame and SQL functions; normalisation and folding are public static methods of the JVM's Unicode library
that ships with Spark, called by the SQL function reflect.

Defined cases: null texts count as empty; repeated rows of the same doc_id and text give a row each and stand side by
side in the order of documents, so that one's next document is that of the last of them; other rows of the same doc_id
are ordered by a hash of their texts; rows without doc_id come last in descending order; with a single document the next document is itself; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timegrid.llm.common import save


def canonical(text: Column) -> Column:
    """The canonical form of a text (null: empty)."""

    def nfkc(c: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.regexp_replace(F.regexp_replace(nfkc(folded), r"[\p{Z}\p{Cc}]+", " "), r"\A | \z", "")


def wide_hash(text: Column) -> Column:
    """128 bits of xxhash as 32 hexadecimal digits: two 64-bit hashes of unlike seeds."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), text)), 16, "0") for seed in (1, 2))))


def group_digests(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document (the general operator)."""
    forms = docs.select("doc_id", F.xxhash64("text").alias("name"), canonical(F.col("text")).alias("_canonical"))
    rows = save(forms.select("doc_id", "name", wide_hash(F.col("_canonical")).alias("digest"), F.sha2("_canonical", 256).alias("sha")), "digests")
    bad = collisions(rows.select("name", "digest"), docs)
    return _settled(rows, bad, "digest", "sha", "fingerprint").select("doc_id", "fingerprint")


def collisions(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The digests (of rows with name, a hash of the text, and digest) that unlike canonical texts share, by comparing the texts' bytes.

    Only documents whose digest occurs again are read again.
    """
    again = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    members = rows.join(again, "digest", "left_semi").select("name").distinct()
    texts = docs.select(F.xxhash64("text").alias("name"), "text").join(members, "name", "left_semi").select(canonical(F.col("text")).alias("_canonical"))
    return unlike(texts.select("_canonical", wide_hash(F.col("_canonical")).alias("digest")))


def unlike(texts: DataFrame) -> DataFrame:
    """The digests whose texts (digest, _canonical) aren't all the same bytes: a task sends two texts of each at most."""
    ends = texts.groupBy("digest").agg(F.min("_canonical").alias("a"), F.max("_canonical").alias("b"))
    return ends.where(F.col("a") != F.col("b")).select("digest")


def _settled(rows: DataFrame, bad: DataFrame, digest: str, sha: str, name: str) -> DataFrame:
    marked = rows.join(bad.select(F.col("digest").alias(digest), F.lit(True).alias("_bad")), digest, "left")
    return marked.withColumn(name, F.when(F.col("_bad"), F.concat(digest, F.lit("-"), sha)).otherwise(F.col(digest))).drop("_bad")


def neighbours(ids: DataFrame) -> DataFrame:
    """For distinct (doc_id, tie): the next in descending order, around the end, and the previous one with its n_chars.

    Rows are dealt into ranges of ids, which become a table; a window runs in each range, and the ranges' ends, a row
    each, meet in a small window of their own.
    """
    down = [F.col("doc_id").desc(), F.col("tie").desc()]
    ranged = save(ids.repartitionByRange(*down).withColumn("part", F.spark_partition_id()), "ranges")
    me = F.struct("doc_id", "tie", "n_chars")
    ends = ranged.groupBy("part").agg(F.max(me).alias("first"), F.min(me).alias("last"))
    line, everything = Window.partitionBy(F.lit(0)).orderBy("part"), Window.partitionBy(F.lit(0))
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(line), F.max("first").over(everything)).alias("after"),
        F.coalesce(F.lag("last").over(line), F.min("last").over(everything)).alias("before"),
    )
    own = Window.partitionBy("part").orderBy(*down)
    near = ranged.withColumn("_next", F.lead(me).over(own)).withColumn("_previous", F.lag(me).over(own)).join(F.broadcast(ends), "part")
    after, before = F.coalesce("_next", "after"), F.coalesce("_previous", "before")
    return near.select(
        "doc_id", "tie", after["doc_id"].alias("next_id"), after["tie"].alias("next_tie"),
        before["doc_id"].alias("previous_id"), before["tie"].alias("previous_tie"), before["n_chars"].alias("previous_chars"),
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: its last third replaced by the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    # a row without id stands as the smallest number; the tie tells it from a row that has that number
    least, no_id = F.lit(-(1 << 63)), F.col("doc_id").isNull()
    text = docs.select(F.coalesce("doc_id", least).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), no_id.alias("no_id")).withColumn("tie", F.xxhash64("no_id", "text"))
    forms = text.select("doc_id", "tie", "no_id", F.length("text").cast("long").alias("n_chars"), canonical(F.col("text")).alias("_canonical"))
    ids = save(forms.select("doc_id", "tie", "no_id", "n_chars", wide_hash(F.col("_canonical")).alias("digest"), F.sha2("_canonical", 256).alias("sha")), "ids")
    again = ids.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.lit(True).alias("again"))
    once = ids.distinct()
    near = neighbours(once.select("doc_id", "tie", "n_chars")).join(once.join(again, "digest", "left"), ["doc_id", "tie"])
    near = save(near, "neighbours")
    placed = text.drop("no_id").join(near, ["doc_id", "tie"])
    starts = placed.select(
        F.col("previous_id").alias("doc_id"), F.col("previous_tie").alias("tie"),
        F.expr("left(text, cast(floor(previous_chars / 3) as int))").alias("start"),
    ).groupBy("doc_id", "tie").agg(F.first("start").alias("start"))
    known = ["doc_id", "tie", "no_id", "n_chars", "next_id", "next_tie", "digest", "sha"]
    both = placed.select(*known, "text", "again").join(starts, ["doc_id", "tie"])
    both = both.withColumn("edited", F.expr("concat(left(text, cast(n_chars - floor(n_chars / 3) as int)), start)"))
    # the canonical texts of digests that occur again go along, to be compared
    forms = both.select(*known, F.sha2("edited", 256).alias("edited_sha256"), F.when(F.col("again"), canonical(F.col("text"))).alias("_canonical"), canonical(F.col("edited")).alias("_edited"))
    rows = save(forms.select(*known, "edited_sha256", "_canonical", wide_hash(F.col("_edited")).alias("edited_digest"), F.sha2("_edited", 256).alias("edited_sha")), "forms")
    bad = unlike(rows.where("_canonical IS NOT NULL").select("digest", "_canonical"))
    every = rows.select("digest", F.col("sha").alias("_canonical")).unionByName(rows.select(F.col("edited_digest").alias("digest"), F.col("edited_sha").alias("_canonical")))
    bad = save(bad.unionByName(unlike(every)).distinct(), "collisions")
    rows = _settled(_settled(rows.drop("_canonical"), bad, "digest", "sha", "fingerprint"), bad, "edited_digest", "edited_sha", "edited_fingerprint")
    following = rows.select(F.col("doc_id").alias("next_id"), F.col("tie").alias("next_tie"), F.col("fingerprint").alias("next_fingerprint")).distinct()
    out = rows.join(following, ["next_id", "next_tie"])
    return out.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"), (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
    )
