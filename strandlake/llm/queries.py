"""The queries of this package: op<N>_<name>, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import graphdedup, langid, mixing, pieces, quality, rules, secrets, simhash, tokenfiles, urlfilter
from strandlake.llm.oracles import ORACLES  # noqa: F401
from strandlake.plans.shared import spread, written


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.draw_key(F.col("doc_id"), F.col("text")).alias("_mix_key"))
    sized = written(sized, "mix-sizes")
    out = mixing.apply_plan(sized, mixing.mix_plan(sized))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op8_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"))


def op9_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(_documents(spark, sf_dir), keep_text=False)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", *[count(k) for k in secrets.BASE_KINDS], F.sha2(secrets.digest(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans")
    )


def op2_graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphdedup.near_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_offsets(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op4_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(_documents(spark, sf_dir))


def op6_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(_documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pareto_mix,
        op2_graph_components,
        op3_token_files,
        op4_neighbour_quality,
        op5_rule_cascade,
        op6_url_trees,
        op7_simhash_components,
        op8_piece_viterbi,
        op9_language_hierarchy,
        op10_secret_scan,
    )
}
