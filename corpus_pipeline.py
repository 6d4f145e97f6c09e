"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
hands the table read back to the next stage.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrabin.llm import op02_decision_list, op06_decontaminate, op07_simhash_cover, op09_arrow_tokens, op10_flow_mix
from terrabin.llm.session import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and a decision list, learned on the labelled ones of them, keep."""
    return op02_decision_list.filtered(docs, op02_decision_list.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component."""
    return op07_simhash_cover.filtered(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which benchmark windows cover less than a twentieth of the words."""
    return op06_decontaminate.filtered(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, unchanged; where a document had to be cut to meet a target, its first words."""
    return op10_flow_mix.repeated(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from the Arrow files written."""
    return op09_arrow_tokens.read_tokens(op09_arrow_tokens.write_tokens(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: The learned rules, XXH64 fingerprints and token ids have no SQL; tests/llm/test_pipeline.py holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
