"""The training-data pipeline over ``documents``: rules, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first three return the columns of
``documents``; the mix repeats or leaves out whole rows. The last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm import mixing, neardup, packing, quality
from sitegauge.llm.queries import byte_bpe
from sitegauge.sources.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject."""
    return quality.kept_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): SimHash fingerprints within
    three bits find the nearest, MinHash bands what is past their reach, whole shingle sets judge both."""
    return neardup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it."""
    return mixing.resampled(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece."""
    # Workers of the stages before live on beside a grown JVM, so these remember less and cut less at a time.
    pieces = packing.token_pieces(docs, byte_bpe(), remembered=150_000, at_a_time=1_000_000)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]
# Fingerprints, rounding by hashes and the tokenizer have no SQL; a test holds the stages against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
