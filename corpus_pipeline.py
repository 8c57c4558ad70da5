"""The training-data pipeline over ``documents``: each stage reads what the one before it wrote.

Defined results, stage by stage: rows with null or empty texts, or texts in no language, go with the first; rows without
doc_id pass near-duplicate removal and decontamination (they are no node, and nothing is asked of their id); of rows that
repeat a doc_id one stays, and of documents alike the one with the least doc_id; a table without rows gives no rows; columns
beside those of ``documents`` are carried up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, langid, minhash, mixing, token_orc
from corpusloom.llm.common import saved, scratch_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: null texts, texts without letters and texts whose words are of no learned language go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Circulant MinHash on five-word shingles at similarity 0.8: the least doc_id of each group stays."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), drop=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: texts are what the mix takes of each document."""
    return mixing.mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as ORC; returns doc_id, start, n_tokens and checksum as read back from the files."""
    return token_orc.token_digest(spark, token_orc.write_token_ids(docs, scratch_dir(spark, "token-ids")))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: Conditional random fields, MinHash components, permutations and byte-pair encoding have no SQL form; the stages are
#: tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
