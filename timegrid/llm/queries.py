"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from timegrid.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from timegrid.llm.pieces import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timegrid.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timegrid.llm.archive import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))



def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timegrid.llm.bitslices import top_neighbours

    return top_neighbours(_table(spark, sf_dir, "embeddings"))



def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timegrid.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))



def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timegrid.llm.ngram_join import linked

    return linked(_table(spark, sf_dir, "documents"))



def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timegrid.llm.rules import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))



def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timegrid.llm.pitman_yor import held_out_scores

    return held_out_scores(_table(spark, sf_dir, "documents"))



def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timegrid.llm.language import identify_pages

    return identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timegrid.llm.manifest import tamper_check

    return tamper_check(_table(spark, sf_dir, "documents"))

def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timegrid.llm.audit import filter_audit

    return filter_audit(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels"))

def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timegrid.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_packing": op3_packing,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op4_warc": op4_warc,
    "op5_topk": op5_topk,
    "op9_fingerprints": op9_fingerprints,
    "op10_ngram_join": op10_ngram_join,
    "op1_quality": op1_quality,
    "op2_lm_score": op2_lm_score,
    "op6_language": op6_language,
    "op11_manifest": op11_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_toxicity": op13_toxicity,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op4_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p), l AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS leader FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> leader THEN leader END AS refers_to FROM l""",
    "op5_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) WHERE rank <= 10""",
    "op10_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM g), u AS (SELECT doc_id, unnest(s) AS x FROM g), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e0 AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)), e AS MATERIALIZED (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(m.least, n.doc_id)) AS component_id FROM n LEFT JOIN m ON m.a = n.doc_id""",
    "op11_manifest": r"""WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
coalesce(octet_length(encode(text)) || ':' || text, '-') AS z, octet_length(encode(CAST(doc_id AS VARCHAR))) AS w FROM documents),
d AS (SELECT doc_id, lang, sha256(a || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || z) AS leaf, sha256(a || coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') || z) AS changed,
xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, w + 1), lambda i: [CAST(-1 - ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)] || list_transform(range(8), lambda j: CAST(0 AS BIGINT))))), lambda c, x: CASE WHEN x < 0 THEN xor(c, -1 - x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 7 = 0 AS hit FROM f),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT 0 AS k, lang, p, n, leaf AS x FROM l UNION ALL SELECT k + 1, lang, p // 2, (any_value(n) + 1) // 2, sha256(string_agg(x, '' ORDER BY p)) FROM t WHERE n > 1 GROUP BY k, lang, p // 2),
s AS MATERIALIZED (SELECT lang, x AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS m FROM t WHERE n = 1),
u AS (SELECT 0 AS k, g, m, subroot AS x FROM s UNION ALL SELECT k + 1, g // 2, (any_value(m) + 1) // 2, sha256(string_agg(x, '' ORDER BY g)) FROM u WHERE m > 1 GROUP BY k, g // 2),
e AS (SELECT l.doc_id, t.k, CASE WHEN o.x IS NULL THEN 0 WHEN o.p < t.p THEN 1 ELSE 2 END AS side, o.x FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.p = l.p >> t.k AND t.n > 1 LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM t.lang AND o.k = t.k AND o.p = xor(t.p, 1)
UNION ALL SELECT l.doc_id, 1000 + u.k, CASE WHEN o.x IS NULL THEN 0 WHEN o.g < u.g THEN 1 ELSE 2 END, o.x FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN u ON u.g = s.g >> u.k AND u.m > 1 LEFT JOIN u o ON o.k = u.k AND o.g = xor(u.g, 1)),
q AS (SELECT doc_id, list(struct_pack(side := side, x := coalesce(x, '')) ORDER BY k) AS way, string_agg(x, '' ORDER BY k) AS joined FROM e GROUP BY doc_id),
v AS (SELECT l.doc_id, l.leaf, s.subroot, (SELECT x FROM u WHERE m = 1) AS root, sha256(coalesce(q.joined, '')) AS proof_sha256,
list_reduce(list_prepend(struct_pack(side := 0, x := CASE WHEN l.hit THEN l.changed ELSE l.leaf END), coalesce(q.way, [])), lambda a, b: struct_pack(side := 0, x := CASE b.side WHEN 0 THEN sha256(a.x) WHEN 1 THEN sha256(b.x || a.x) ELSE sha256(a.x || b.x) END)).x AS folded_root
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN q ON q.doc_id = l.doc_id)
SELECT *, folded_root = root AS verified FROM v""",
    "op12_filter_audit": r"""WITH RECURSIVE o AS (SELECT '' AS filter_order, 0 AS k UNION ALL SELECT filter_order || c, k + 1 FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE k < 5 AND NOT contains(filter_order, c)),
s AS (SELECT filter_order, CAST(step AS INT) AS step, CAST(1 << (ascii(filter_order[step]) - 65) AS BIGINT) AS own, CAST(coalesce(list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(filter_order[j]) - 65))), 0) AS BIGINT) AS before FROM o, range(1, 6) r(step) WHERE k = 5),
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(quality = 1, FALSE) AS good, coalesce(toxic = 1, FALSE) AS toxic, CAST((len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, FALSE)::INT AS BIGINT) AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (mask & (own | before) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(g) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
CAST(coalesce(sum(x) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & own <> 0), 0) AS BIGINT) AS shapley FROM c, s GROUP BY part, filter_order, step""",
}
