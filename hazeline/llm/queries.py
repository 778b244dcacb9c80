"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm import crf, hamming, htmlextract, mixing, neardup, packing, perplexity, prefixtrie, secrets, sharding, suffixdedup, urlfilter, variants
from hazeline.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(query):
    QUERIES[query.__name__] = query
    return query


@registered
def op7_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@registered
def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op9_systematic_mix"] = mixing.ORACLE


SHARD_BYTES = 64 << 20


@registered
def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(table(spark, sf_dir, "documents"), ["doc_id"], SHARD_BYTES)


ORACLES["op1_extendible_shards"] = sharding.ORACLE.format(limit=SHARD_BYTES)


@registered
def op3_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@registered
def op8_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(table(spark, sf_dir, "documents")).drop("lang")


@registered
def op2_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


@registered
def op10_template_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extracted(table(spark, sf_dir, "pages"))


@registered
def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op5_multi_index_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 10)


ORACLES["op5_multi_index_top_k"] = hamming.ORACLE


@registered
def op6_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = urlfilter.evaluated(urlfilter.dated_captures(pages), urlfilter.dated_entries(pages))
    return found.withColumn("fetched_on", F.col("fetched_on").cast("string"))


ORACLES["op6_temporal_url_lists"] = urlfilter.ORACLE


@registered
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_prefix_trie"] = prefixtrie.ORACLE


@registered
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


ORACLES["op12_spelling_variants"] = variants.ORACLE


@registered
def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.deduplicated(table(spark, sf_dir, "documents"))


ORACLES["op13_suffix_array_dedup"] = suffixdedup.ORACLE
