"""A corpus pipeline: language, quality, near-duplicates, decontamination, tokens.

Each stage takes what its predecessor kept, written as Parquet and read again. All
but the last return the columns of ``documents``; the last one has the digests of
each document's token ids and of the text they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollspark.llm import alike, decontam, langid, quality, queries, simhash
from rollspark.llm.common import load, remainder, store


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay."""
    return langid.keep_known(docs, langid.train(docs, remainder("doc_id", 4) != 2))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality stay."""
    model = quality.train(docs, load(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return quality.keep_good(docs, model)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; two are linked if the Jaccard of their five-word shingles is 0.8 or more.

    Pairs come from SimHash fingerprints by tables of distances to pivots, and from MinHash buckets where 64 bits tell too little.
    """
    return simhash.keep_one(docs, width=alike.SHINGLE, grouped=alike.group)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    return decontam.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of tokens and of decoded text."""
    return queries.bpe_digests(docs)


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("bpe", token_stage),
]

# Two stages are learnt models and one hashes to fingerprints that SQL has no function for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
