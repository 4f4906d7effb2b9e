"""The operators over their whole tables with production parameters, and SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecairn.llm import (
    acsearch,
    bpe,
    chosenpath,
    exthash,
    knlm,
    langid,
    lshforest,
    pfair,
    quality,
    simhash,
    tokalign,
    tokenbin,
    toxicity,
)
from tracecairn.llm.common import fold, table

#: Target weights of the sources; all others share the last one.
MIX = {"src0": 6, "src1": 3, "src2": 3, "src3": 2, "src4": 2, pfair.OTHER: 4}
MIX_BLOCK, MIX_SEED = 8, 7
SHARD_BYTES, SHARD_SEED = 1 << 20, 11
END_ID = 2
QUALITY_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                   "n_repeat_words", "base_failed", "kept")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold("doc_id", 4) != 2))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "lang_share")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.encode_and_read(table(spark, sf_dir, "documents"),
                                    tokenizer_file("byte_bpe_50k.json"), END_ID)


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.interleave(docs, MIX, MIX_BLOCK, MIX_SEED).select("doc_id", *pfair.RESULTS)


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exthash.write_and_read(table(spark, sf_dir, "documents"), SHARD_BYTES, SHARD_SEED)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"),
                          tokenizer_file("byte_bpe_50k.tiktoken"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted text: documents labelled as good. Every fourth sets the thresholds."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return knlm.classify(table(spark, sf_dir, "documents"), trusted, fold("doc_id", 4) == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return lshforest.nearest(rows, F.col("vec_id") % 50 == 0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, carry=["doc_id"]).select(*QUALITY_COLUMNS)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokalign.cross_align(table(spark, sf_dir, "documents"),
                                tokenizer_file("byte_bpe_50k.json"),
                                tokenizer_file("piece_bpe_32k.model"))


def op12_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id, op2_simhash, op3_token_shards, op4_pfair_mix, op5_extendible_shards,
        op6_byte_bpe, op7_kneser_ney, op8_toxicity,
        op9_lsh_forest, op10_quality_rules, op11_token_alignment, op12_chosen_path,
        op13_lexical_search)}


def all_sql() -> dict[str, str]:
    return {
        "op4_pfair_mix": pfair.sql(MIX, MIX_BLOCK, MIX_SEED),
        "op5_extendible_shards": exthash.sql(SHARD_BYTES, SHARD_SEED),
        "op10_quality_rules": quality.sql(),
        "op13_lexical_search": acsearch.sql(),
    }
