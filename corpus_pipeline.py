"""The corpus pipeline: language, quality, near duplicates, packing. Each stage's decisions hold for all that follow."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm import langid, minhash, packing, repetition, simhash
from formline.llm.common import components, free_name, small_batches
from formline.session import cut_lineage

#: SQL has neither learned classifiers, suffix arrays, XXH64 nor packing: run() is tested against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language. Those without text or letters go; so do those whose best language is both
    ambiguous and has under half of the likelihood."""
    small_batches(spark)
    return langid.recognised(docs, langid.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules and are not too short."""
    small_batches(spark)
    return repetition.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group. Documents are linked by SimHash fingerprints at 4 or fewer differing
    bits (op6), and by sets of 5-word shingles at a Jaccard similarity of 0.8 or more, most of which no fingerprint shows;
    groups are the components of both kinds of links."""
    small_batches(spark)
    row = free_name(docs, "near_dup_row")
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = simhash.near_groups(numbered, row).select(row, "component_id").unionByName(minhash.near_groups(numbered, row))
    links = cut_lineage(groups.filter(F.col(row) != F.col("component_id")).select(F.col("component_id").alias("a"), F.col(row).alias("b")).distinct())
    later = components(links).filter("node != component_id").select(F.col("node").alias(row))
    return numbered.join(later, row, "left_anti").drop(row)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece of a document."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's rows are a Parquet table before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
