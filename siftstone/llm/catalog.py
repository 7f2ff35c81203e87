"""Queries of this subpackage, by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftstone.llm import codes, hmm, language, minhash, mixing, packing, pieces, quality, suffix, topk, toxicity, trie, vector_dedup
from siftstone.plans.scan import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """All of a table; a small one in fewer pieces than there are cores is dealt over them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pca_tiled_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.similar_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)


def op3_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_inner_products(vectors, vectors.where("vec_id % 20 = 0"))


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op6_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_hidden_markov_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(_table(spark, sf_dir, "documents"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op11_delta_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_table(_table(spark, sf_dir, "embeddings"))


def op12_agenda_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_leaf_peeling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_neighbour_quality, op2_pca_tiled_dedup, op3_norm_sorted_topk, op4_ordinal_toxicity, op5_kneser_ney_language, op6_bucket_pointer_dedup, op7_tensored_minhash, op8_hidden_markov_score, op9_harmonic_packing, op10_pfair_mixing, op11_delta_lloyd_codes, op12_agenda_sentencepiece, op13_leaf_peeling_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op2_pca_tiled_dedup": vector_dedup.ORACLE, "op3_norm_sorted_topk": topk.ORACLE, "op6_bucket_pointer_dedup": suffix.ORACLE, "op7_tensored_minhash": minhash.ORACLE, "op10_pfair_mixing": mixing.ORACLE, "op11_delta_lloyd_codes": codes.ORACLE, "op13_leaf_peeling_trie": trie.ORACLE}
