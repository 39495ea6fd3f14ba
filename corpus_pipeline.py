"""A corpus through five of the training-data operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.  A stage's result
is written as Parquet and read again before the next one.

1. Quality rules: failing lines go from the texts, rejected documents go.
2. Quality classifier: fitted to the labels of ``documents``, held-out ids
   aside, good ones cleaned as stage 1 does; documents that it rejects go.
3. SimHash near-duplicates: one document of each group stays.  Fingerprints of
   5-word shingles are compared bit-sliced within a wide radius, and links are
   confirmed by exact Jaccard similarity of at least 0.8 (op7's contract binds
   only op7).
4. Source mix: documents are sampled to flattened source, language and topic
   shares.
5. Byte-level BPE: the kept texts are encoded and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colsense.llm import _common, byte_bpe, line_crf, near_copies, quality_rules, source_mix


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove failing lines and drop the documents that the rules reject."""
    return quality_rules.filtered(docs)


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects; it learns from good texts as the rules leave them and from bad ones as they came."""
    chain = line_crf.train(_common.table(spark, sf_dir, "documents"), _common.table(spark, sf_dir, "labels"), view=quality_rules.learned)
    return line_crf.accepted(docs, chain)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return near_copies.first_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents to flattened shares of source, language and topic."""
    return source_mix.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every kept document and return digests of its ids and of the decoded bytes."""
    return byte_bpe.digests(docs)


STAGES = [("quality rules", rules), ("quality classifier", classified), ("SimHash near-dedup", unique), ("source mix", mixed), ("byte-level BPE", encoded)]

#: SQL can express neither the classifier nor the encoder; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = _common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = _common.written(docs, "stage")
    return docs
