"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each step groups what the step before left in groups of two or more, by a key that costs more to make:

1. the length in bytes of every text, counted; a text alone with its length is unlike all others,
2. the hash of the first characters, only of texts whose length came up again, counted per length,
3. SHA-256 of the whole text, only of texts whose length and prefix came up again.

Rows carry keys from step to step, never texts: each step goes over the input anew, and what is shuffled is counts
per key, combined before the shuffle, and at the end one narrow row per row that was fully hashed. So a group of
any size costs one row per task in the counts. In the last join, which hands out each group's kept id, one side has
one row per group and is read anew from the shared folder, so Spark can split the other where one group is large.

The keys that survive a step are handed to the scans by broadcast while they are few, which is checked by counting
them. Beyond that they are joined by shuffle; so that no text enters that shuffle, the next key is then made
before the join, for all rows of the step before. Results do not depend on it.

Only built-in functions run; no Python.

Edge cases: a null text counts as empty, and empty texts are equal. Texts are compared without any change, so case
and spaces matter. Of equal texts the row with the largest id stays. Rows that repeat id and text are one document
stored twice: they count twice in ``group_size`` and stay or go together. A null id is smaller than any other; if
all ids of a group are null, ``keep_id`` is null and the rows stay. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.llm.base import store

PREFIX = 128  # characters of the prefix hash
SENT_KEYS = 500_000  # surviving keys that are broadcast at most: 16 bytes each, some 50 MB as a hash table


def _again(rows: DataFrame, *key: str) -> DataFrame:
    """Keys of two rows or more, stored."""
    return store(rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))


def _few(keys: DataFrame) -> bool:
    return keys.limit(SENT_KEYS + 1).count() <= SENT_KEYS


def _marked(rows: DataFrame, keys: DataFrame, sent: bool) -> DataFrame:
    """``rows`` with ``_again``: their key is among ``keys``, which are ``sent`` to all tasks or else joined by shuffle."""
    known = keys.withColumn("_again", F.lit(True))
    met = rows.join(F.broadcast(known) if sent else known, keys.columns, "left")
    return met.withColumn("_again", F.col("_again").isNotNull())


def refined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every_hash: bool = False) -> DataFrame:
    """Per row ``doc_id, n_bytes, prefix, again, full``: ``again`` where length and prefix came up again.

    ``full`` is null where not ``again``, unless ``every_hash`` asks for it on all rows, for callers who report it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    rows = rows.withColumn("n_bytes", F.octet_length("_text").cast("bigint"))
    prefix = F.xxhash64(F.substring("_text", 1, PREFIX))
    full = F.sha2(F.col("_text").cast("binary"), 256)

    lengths = _again(rows.select("n_bytes"), "n_bytes")
    sent = _few(lengths)
    # the next key is made after the join where no shuffle carries the text, before it where one would
    second = _marked(rows if sent else rows.withColumn("prefix", prefix).drop("_text"), lengths, sent)
    second = second.where("_again").select("n_bytes", (prefix if sent else F.col("prefix")).alias("prefix"))
    prefixes = _again(second, "n_bytes", "prefix")

    if sent and _few(prefixes):
        third = _marked(rows, lengths, True)
        third = third.withColumn("prefix", F.when(F.col("_again"), prefix)).drop("_again")
        third = _marked(third, prefixes, True)
    else:
        third = _marked(rows.withColumns({"prefix": prefix, "full": full}).drop("_text"), prefixes, False)
        full = F.col("full")
    third = third.withColumn("full", full if every_hash else F.when(F.col("_again"), full))
    return third.select("doc_id", "n_bytes", "prefix", F.col("_again").alias("again"), "full")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every_hash: bool = False) -> DataFrame:
    """Per row ``doc_id, keep_id, group_size, kept, n_bytes, full``; ``full`` as in `refined`."""
    rows = store(refined(docs, id_col, text_col, every_hash))
    alone = rows.where("not again").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "n_bytes", "full"
    )
    again = rows.where("again")
    key = ["n_bytes", "full"]
    same = store(again.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    met = again.join(same, key).select("doc_id", "keep_id", "group_size", "n_bytes", "full")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return alone.unionByName(met).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "n_bytes", "full")
