"""Whole texts dealt into chunks of bounded size, kept in that layout for several passes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.llm.base import shared_folder

CHUNK_BYTES = 4 << 20
MAX_BUCKETS = 8_192


@dataclass
class Dealt:
    """``rows``: doc_id, text (bytes; empty for null), digest, chunk, of every row; grouping by ``chunk``
    shuffles nothing, since the table is bucketed by it.
    ``leaders``: chunk, digest, doc_id of one row per different text, that of the smallest id that is not
    null, with the number of rows (``copies``).
    """

    rows: DataFrame
    leaders: DataFrame
    n_bytes: int


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Dealt:
    """Texts go to chunks by a hash of id and text, so copies of one text spread over all chunks."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-n_bytes // chunk_bytes))
    n_buckets = min(n_chunks, MAX_BUCKETS)

    def chunk() -> Column:
        return F.pmod(F.xxhash64("doc_id", "digest"), F.lit(n_chunks)).alias("chunk")

    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    name = f"pacemark_llm_{uuid.uuid4().hex}"
    (
        rows.select("*", chunk())
        .repartition(n_buckets, "chunk")
        .write.option("compression", "zstd")
        .option("path", f"{shared_folder(spark).rstrip('/')}/pacemark-llm/{name}")
        .bucketBy(n_buckets, "chunk")
        .saveAsTable(name, format="parquet")
    )
    table = spark.table(name)
    leaders = table.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return Dealt(table, leaders.select(chunk(), "digest", "doc_id", "copies"), n_bytes)
