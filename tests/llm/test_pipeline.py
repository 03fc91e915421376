"""The pipeline against brute-force versions of its stages."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_corpus import encoded_by_library, hard, joined_by_force, mixed_by_force, tokenizer  # noqa: F401
from wavegrid.llm import bpe, common, mixing, pii, quality_rules

SF = f"{DATA}/sf0.001"
NAMES = ["quality rules", "n-gram Jaccard join", "PII", "mixing sources to target weights", "BPE encoding and decoding"]


def test_stages_have_the_contracts_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES


def test_pipeline_equals_brute_force(spark, tokenizer):  # noqa: F811
    docs = common.documents(spark, SF)
    refs = quality_rules.references(docs)
    rows = [r for r in docs.collect() if quality_rules.measure(r.text, r.lang, refs, quality_rules.LIMITS)[-1]]
    group = joined_by_force([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if group[r.doc_id][1] == r.doc_id]
    scores = pii.scores_of(*pii.train(pii.sample_texts(spark.createDataFrame(rows))))
    texts = {}
    for r in rows:
        base = pii.base_spans(r.text)
        texts[r.doc_id] = pii.redacted(r.text, base + pii.added_spans(r.text, scores, base))
    leaf = {r.source: r.d for r in spark.createDataFrame(rows).select("source", mixing.default_domain(F.col("source")).alias("d")).distinct().collect()}
    taken = mixed_by_force([(r.doc_id, (leaf[r.source], r.lang, r.source), len(texts[r.doc_id].encode().split())) for r in rows], mixing.WEIGHTS, 0.8, 1, 13)
    want = {i: encoded_by_library(tokenizer, texts[i]) for i, _ in taken}
    got = {r.doc_id: (r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < len(rows)


def test_stages_on_hard_rows(spark, hard):  # noqa: F811
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, hard, SF)
        rows = out.collect()
        assert len(rows) <= hard.count(), name
        if name != NAMES[-1]:
            assert out.columns == hard.columns and dict(out.dtypes) == dict(hard.dtypes), name
    kept = {r.doc_id for r in corpus_pipeline.stage_near_duplicates(spark, hard, SF).collect()}
    assert {0, 1, 2, None, 8} <= kept and not kept & {9, 10, 11, 30, 31, 5}
    clean = {r.doc_id: r for r in corpus_pipeline.stage_pii(spark, hard, SF).collect()}
    assert clean[13].text == "[EMAIL] [IP] [PHONE], [CARD]" and clean[13].n_chars == len(clean[13].text) and clean[3].text == "one"
    assert np.frombuffer(corpus_pipeline.stage_bpe(spark, hard, SF).where("doc_id = 3").first().ids, "<u4").size == 1


def test_stages_on_an_empty_table(spark, hard):  # noqa: F811
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, hard.limit(0), SF).count() == 0, name


def test_vocabulary_is_a_parameter():
    assert bpe.default_vocabulary().endswith(".json")
