"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its
result is written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents.

Defined cases, for every stage: a null, empty or blank text fails the quality rules, and is kept by a stage that is given
it by itself as that operator's docstring says; null ids, languages and sources are values of their own; very long texts are worked on
whole; ties go to the smaller doc_id or line; a repeated row is judged like its copy (line dedup and near-dedup keep rows of one id together);
an empty table gives an empty table; further columns go along to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrykit.llm import linedup, minhash, mixing, packing, quality
from quarrykit.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their language's fertility band."""
    return quality.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line makes redundant."""
    return linedup.deduplicated(docs, 0.8)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles."""
    return minhash.deduplicated(docs, 5, 0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, length, bucket, boundary, batch, slot, padding of every document taken."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Tokenisation, similarity joins and the packing programme are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
