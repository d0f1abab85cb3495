"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_prefix, conversation_repair, fertility, importance, lattice_lm, mixing, pii, sentencepiece_wfst, simhash, spotsigs, toxicity, url_filter, warc
from .common import table

#: Folder of public tokenizer files.
TOKENIZERS = "/opt/tokenizers"


def op1_sentencepiece(spark: SparkSession, sf_dir: str, path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    return sentencepiece_wfst.encode(table(spark, sf_dir, "documents"), sentencepiece_wfst.read_model(path), kept=400_000)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(table(spark, sf_dir, "pages"))


def op4_fertility(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    return fertility.query(table(spark, sf_dir, "documents"), folder)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op6_lattice(spark: SparkSession, sf_dir: str, path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), sentencepiece_wfst.read_model(path))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.query(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.query(table(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    with open(path, "rb") as f:
        return bpe_prefix.query(table(spark, sf_dir, "documents"), f.read())


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc": op2_warc,
    "op3_url_filters": op3_url_filters,
    "op4_fertility": op4_fertility,
    "op5_mixing": op5_mixing,
    "op6_lattice": op6_lattice,
    "op7_toxicity": op7_toxicity,
    "op8_spotsigs": op8_spotsigs,
    "op9_simhash": op9_simhash,
    "op10_pii": op10_pii,
    "op11_importance": op11_importance,
    "op12_conversations": op12_conversations,
    "op13_bpe": op13_bpe,
}
ORACLE_SQL: dict[str, str] = {"op2_warc": warc.ORACLE_SQL, "op3_url_filters": url_filter.ORACLE_SQL, "op11_importance": importance.ORACLE_SQL, "op12_conversations": conversation_repair.ORACLE_SQL}
