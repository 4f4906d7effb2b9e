"""From raw documents to token ids: toxicity, quality, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before has kept, and
returns a DataFrame that is written as Parquet and read again. All but the last return the columns
of ``documents``.

Null, empty and blank texts are not toxic and fail the base rule of the quality stage, so they end
there. Rows with a null id, and rows of one id with different texts, are documents of their own in every
stage; of equal rows one stays. A null source is mixed with the sources that have no weight of their own. An
empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecairn.llm import bpe, pfair, quality, simhash, toxicity
from tracecairn.llm.common import table
from tracecairn.llm.queries import MIX, MIX_BLOCK, MIX_SEED, tokenizer_file
from tracecairn.operators.storage import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of the input, doesn't call toxic."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).where(F.col("kept")).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the interleaved order: the files and their rows follow the schedule."""
    return pfair.mixed_order(docs, MIX, MIX_BLOCK, MIX_SEED)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, one row a document, with its place in the mix.

    The mixing stage keeps every row, so the schedule over its rows is the same again.
    """
    placed = pfair.interleave(docs, MIX, MIX_BLOCK, MIX_SEED).select(
        F.struct("doc_id", "mix_position").alias("doc_id"), "text")
    return bpe.round_trip(placed, tokenizer_file("byte_bpe_50k.tiktoken")).select(
        "doc_id.*", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("SimHash near-dedup", keep_one_of_each),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]
#: Learned stages and fingerprints by XXH64 have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
