"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing to target weights, packing.

Every stage is (name, function of (spark, docs, sf_dir)). All but the last return documents' columns. Each
result is written as Parquet in the shared folder and reread as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import line_dedup, mixing, packing, simhash, toxicity
from corpusloom.llm.common import stage, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, calls toxic go."""
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go from the texts; every document stays, n_chars follows."""
    return line_dedup.rewritten_documents(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; fingerprints within 2 bits link, and five-word shingles at a Jaccard similarity of at least 0.8."""
    return simhash.deduplicate_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: whole documents, each as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The classifier, SimHash and tokenizers have no SQL form; tests hold the run against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name).df
    return docs
