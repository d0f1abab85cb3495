"""A training corpus from raw documents: five stages, each of one operator.

Every stage keeps the columns of docs, whatever their names; none is meant but
doc_id, text, source and n_chars.  Null and empty texts, rows without an id,
rows that share one, repeated rows, very long texts and empty tables pass
through all of them (each operator's function says how); an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import mixing, pii, sentencepiece_wfst, simhash, toxicity
from ledgerloom.llm.common import cut, table
from ledgerloom.llm.queries import TOKENIZERS


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the severity model rejects."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near-duplicates: texts whose five-word shingles are alike to 0.8 or more."""
    return simhash.keep_one(docs, width=5, likeness=0.8)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; n_chars follows the text."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", pii.length(out)) if "n_chars" in out.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target weight, some documents more than once and some not at all."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; documents that the mix repeats are repeated."""
    return sentencepiece_wfst.encode(docs, sentencepiece_wfst.read_model(f"{TOKENIZERS}/piece_bpe_32k.model"))


STAGES = [("toxicity", clean), ("simhash_dedup", deduplicate), ("pii", redact), ("mixing", mix), ("sentencepiece", encode)]

#: No stage can be told in SQL: a fitted model, components, transducers and a random walk.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
