"""The corpus pipeline: quality, exact copies, near copies, mixing, packing.

Each stage takes what its predecessor kept and is written as Parquet in the shared
folder, so a lost executor costs at most the running stage. All but the last stage return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivermark.llm.common import Copies, table
from rivermark.llm.exact_dedup import drop_copies
from rivermark.llm.mixing import ADDED, mixed
from rivermark.llm.near_dedup import drop_near_copies
from rivermark.llm.packing import default_tokenizer, digest, pack
from rivermark.llm.quality import good_documents
from rivermark.registry import query


#: The near-copy stage compares shingles of five words; four belong to the contract of its query.
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, SHINGLE_WORDS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs).drop(*ADDED)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest(pack(docs, default_tokenizer()))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Weighted votes, min-max hashing and online packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs, copies = table(spark, sf_dir, "documents"), Copies(spark)
    for _, stage in STAGES[:-1]:
        docs = copies.write("stage", stage(spark, docs, sf_dir))
        copies.drop("stage", keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)


@query("pipeline", ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
