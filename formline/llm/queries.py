"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from formline.llm import alignment, html, langid, masked_lm, packing, phrases, pieces, repetition, sharding, simhash, subspace, tree_bpe, urls
from formline.llm.phrases_sql import PHRASES_SQL
from formline.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document: 4-word shingles, at most 4 differing bits."""
    return simhash.near_groups(table(spark, sf, "documents")).select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048."""
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_piece_encoding")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids and decoded text as digests."""
    return pieces.digests(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_quality_repetition")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Repetition counts and the verdict for every document."""
    return repetition.judge(table(spark, sf, "documents"))


@query("op9_sharding")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in one of 40 shards of near equal bytes."""
    return sharding.shard_by_bytes(table(spark, sf, "documents"))


@query("op1_language_id")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from labelled documents that are not held out."""
    docs = table(spark, sf, "documents")
    return langid.identify(docs, langid.fit(docs))


OP2_SQL = r"""
WITH rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
parts AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path, row_number() OVER () AS n
    FROM pages
),
fits AS (
    SELECT n, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
    FROM parts JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
    GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""


@query("op2_url_filter", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every page's url by the fixed rules; what no rule lists is allowed."""
    return urls.judge(spark, table(spark, sf, "pages"), urls.RULES)


@query("op10_main_text")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf, "pages")
    return html.main_text(pages, html.fit(pages))


@query("op3_embedding_near_dedup")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95 or more."""
    return subspace.near_vectors(table(spark, sf, "embeddings"))


@query("op8_lm_scoring")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under a network trained on all of them."""
    words = masked_lm.numbered(table(spark, sf, "documents"), "doc_id")
    return masked_lm.score_words(words, masked_lm.train_words(words))


@query("op11_phrase_collocations", PHRASES_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """The best-scored phrases of every language, counted over all documents."""
    return phrases.collocations(table(spark, sf, "documents"))


@query("op12_cross_tokenizer_alignment")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """How the tokens of two tokenizers overlap in every document."""
    return alignment.align(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_byte_bpe_encoding")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids and decoded bytes as digests."""
    return tree_bpe.digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
