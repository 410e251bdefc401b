"""The pipeline's stages on the smallest tables: columns, decisions, and what they may not lose."""

import os

import pytest

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark):
    import corpus_pipeline
    from timegrid.llm.common import save

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = seen
        seen = save(stage(spark, before, SF), name)
        if name == "near_duplicates":
            # one document of each class of the brute-force join stays, that of the smallest id
            from tests.llm.test_operators import brute_components

            rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
            firsts = {c for i, n, c in brute_components(rows, 5, 80)}
            assert {r.doc_id for r in seen.collect()} == firsts
        assert seen.columns == columns
        assert seen.join(before, columns, "left_anti").count() == 0
    packed = save(corpus_pipeline.STAGES[-1][1](spark, seen, SF), "packed")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in seen.select("doc_id").collect()}
    assert packed.where("piece = 0").count() == seen.count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_a_worker_keeps_a_bounded_number_of_words():
    import public_tokenizers
    import pyarrow as pa

    from timegrid.llm.packing import WordIds

    words = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join("".join("abcdefghij"[int(d)] for d in str(i)) for i in range(k, k + 50_000)) for k in range(0, 700_000, 50_000)]
    first = words.ids(pa.array(texts[:1]))[0].tolist()
    for text in texts[1:]:
        words.ids(pa.array([text]))
        assert len(words.known) <= 360_000
    assert words.ids(pa.array(texts[:1]))[0].tolist() == first
