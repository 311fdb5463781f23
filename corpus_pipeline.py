"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns
the columns of ``documents``; the last returns one row per packed piece. A stage's result
is written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callscope.llm import common, packing, quality, secrets, simhash, suffixes
from callscope.llm.queries import tokenizer
from callscope.session import prepare


#: Bytes of a passage that the suffix stage cuts out when it comes again: some fifty short words.
PASSAGE = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the repetition limits reject go."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    return simhash.keep_first(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of ``PASSAGE`` bytes and more are cut out; the first copy stays."""
    return suffixes.deduplicated(docs, length=PASSAGE)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay."""
    return secrets.masked(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]
#: Suffix arrays, fingerprints and tokenizers are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
