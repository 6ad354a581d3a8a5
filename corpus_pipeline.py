"""From raw documents to token ids: language identification, near-deduplication, substring deduplication, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; all but the last return the columns of documents.
Further columns, whatever their names, go through the stages as they are. An empty table gives an empty result at every stage. Ties are
resolved by id and then by hashes, so that reruns agree; very long texts are worked on whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replog.llm import byte_bpe, language, minhash, mixing, substrings
from replog.llm.common import WORD, named, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those too far from every language, or without a letter (null and empty ones too), go."""
    return language.recognised(docs, language.fit(docs, language.learnable()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, one row an id; documents without words and rows without an id stay."""
    return minhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier one; those of which no word is left go, and n_chars follows the text. Untouched rows (null and empty texts too) stay as they are."""
    found, removed = substrings.deduplicate(docs), named(docs, "removed")
    left = found.filter((F.size(removed) == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.when(F.size(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are not taken."""
    return mixing.sample_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document in the mix, repeats included; decoded_sha256 of the bytes that the ids decode to, and decoded_equal, whether a text of that id has the same."""
    coded = byte_bpe.encode(docs, decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    own = docs.select(F.col("doc_id").alias("_doc"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_sha256")).distinct()
    joined = coded.join(own, (F.col("decoded_sha256") == F.col("_sha256")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return joined.select("doc_id", "n_tokens", "ids", "decoded_sha256", F.col("_sha256").isNotNull().alias("decoded_equal"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mix", source_mix), ("byte_bpe", encode)]
#: No stage can be expressed in SQL; the tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
