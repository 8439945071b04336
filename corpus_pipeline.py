"""A training corpus in five steps: each reads what the one before it kept.

``STAGES`` lists name and function; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame.
`run` writes the result of each as Parquet into the shared folder and reads it again as the next one's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacemark.llm import bpe, mixing, nearcopies, secrets, simhash, toxicity
from pacemark.llm.base import store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; the fit reads the stage's own documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs.select("doc_id", "text"), labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles: the one with the smallest id."""
    return simhash.one_of_each(docs, groups=nearcopies.near_copies(docs))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the scan finds no secret."""
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its target, some more than once."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the bytes decoded from them, with their number and the digests of both."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    commas = F.length("ids") - F.length(F.replace(F.col("ids"), F.lit(",")))
    return coded.select(
        "doc_id",
        F.when(F.col("ids") == "", 0).otherwise(commas + 1).cast("bigint").alias("n_tokens"),
        "ids",
        "decoded",
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("secrets", drop_secrets),
    ("mixing", mix_sources),
    ("bpe", pack),
]

#: Trained models and fingerprints are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
