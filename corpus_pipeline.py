"""A training-data pipeline over documents: STAGES in order, each on all that the one before kept.

1. quality: documents that the neighbour vote rejects (score below 0.3) go.
2. near_duplicates: one document of each SimHash group stays, the one of the smallest doc_id. Links are sketches of
   512 bits over five-word shingles, within the bits that texts 0.8 alike differ in (op7 itself links
   64-bit fingerprints of three-word shingles at 3 bits).
3. secrets: spans of secrets in texts are masked; every document stays.
4. mix: each document is repeated as often as the mix of sources takes it, which may be never.
5. pieces: the whole texts as piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import mixing, pieces, quality, secrets, simhash

WORDS, SIMILARITY = 5, 0.8


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs, words=WORDS, similarity=SIMILARITY)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.scrub(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", _quality), ("near_duplicates", _near_duplicates), ("secrets", _secrets), ("mix", _mix), ("pieces", _pieces)]

#: The stages fit a classifier, hash and segment: SQL doesn't express them. The tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.plans.shared import spread, written

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
