"""The pipeline's stages: functions of (spark, docs, sf_dir), from DataFrame to DataFrame.

Each works on all rows of docs and decides by the operator that it calls; all but the last give
the columns of docs back, extra ones included.

Edge cases, beside those of the operators: a null or empty text has too few words for the quality
stage, and goes there; in the other stages it is a document like any other, linked with nothing,
without personal data or tokens. Nulls in lang and source are names of their own. Very long texts
go through whole. Of repeated rows with a doc_id the near-duplicate stage leaves one; rows with one
doc_id and unlike texts stay or go together; rows without a doc_id all stay. An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.llm import bpe, mixing, ngram_join, pii, quality_rules
from wavegrid.llm.common import columns_of, cut, free_name, small_side


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep."""
    name = free_name(docs, "quality")
    return quality_rules.quality_rules(docs).where(F.col(f"{name}.kept")).select(*columns_of(docs, *docs.columns))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, keeps the document with the smallest doc_id; of equal rows with a doc_id, one."""
    groups = cut(ngram_join.near_duplicates(docs).select("doc_id", "component_id"))
    gone = cut(groups.where("component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(small_side(gone), "doc_id", "left_anti")
    repeated = cut(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.count():
        repeated = small_side(repeated)
        once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once)
    return kept.select(*columns_of(docs, *docs.columns))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows."""
    name = free_name(docs, "pii")
    found = pii.find_spans(docs, redact=True)
    text = F.col(f"{name}.redacted")
    changed = {"text": text, "n_chars": F.when(F.size(f"{name}.base") + F.size(f"{name}.added") > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes 80 % of the tokens, mixed to the target weights, each document once at most."""
    mixed = mixing.mix(docs, mixing.default_domain(F.col("source")), mixing.WEIGHTS, budget_share=0.8, max_epochs=1)
    return mixed.select(*columns_of(docs, *docs.columns))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit) and the hash of what they decode to."""
    name = free_name(docs, "bpe")
    out = bpe.bpe_tokens(docs, bpe.default_vocabulary())
    return out.select("doc_id", "lang", "source", f"{name}.n_tokens", f"{name}.ids", f"{name}.decoded_sha256")
