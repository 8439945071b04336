"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits, cut into 16 segments of 4 bits that stand in a ring. If two fingerprints
differ in at most 3 bits, then the differences, 3/16 of a bit per segment, cannot exceed this share
along every way round: there is a segment from which each chain of the next 1, 2, .. 16 segments has at
most 3/16 bit per segment. So the first 5 segments of that chain are equal, the first 10 differ in one
bit at most and the first 15 in two at most. Equal 5 segments (20 bits, at 16 places) are the join key;
the longer chains prune the candidates before the whole distance is counted. Nothing is lost by this.

Where so many different fingerprints exist that 20 bits do not part them, the chain is made part of the
key further on: the next segments may hold one difference altogether, so one side of the join lists its
value and all values one bit away. That changes the plan only, never the links.

Texts with equal fingerprints are one node, whatever their number; links and components are made
between different fingerprints. Nodes are labelled over the shared folder (`base.components`).

Edge cases: a null or blank text has no words and the fingerprint zero, linked like any other; a text
of one or two words is a single shingle. Repeated rows and null ids stay as they are; a group's
``component_id`` is its smallest id that is not null. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.llm.base import components, store
from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

SEGMENTS, WIDTH, DISTANCE = 16, 4, 3
SHINGLE, SEED = 3, 42
EXACT = 5  # segments of the chain without a difference: floor(5 * 3 / 16) = 0
CHUNK = 1 << 16  # shingles whose bits are counted at once


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have bit 0, 1, .. 63."""
    total = np.zeros(64, np.int64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # 255 rows fit a byte's sum
    if whole:
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one UTF-8 text, as a signed 64-bit number."""
    words = (text or b"").lower().split()  # both know ASCII only: A-Z; space and \x09-\x0D
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        n, parts = 1, iter(words)
    else:
        n = len(words) - shingle + 1
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        size = min(CHUNK, n - at)
        hashes = (digest(next(parts), seed) for _ in range(size))
        counts += bit_counts(np.fromiter(hashes, np.uint64, size))
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (BIGINT, two's complement) and ``h``, a hash that tells texts apart, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=["doc_id", "fp", "h"]
            )

    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("h")
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, fp bigint, h bigint")


def _turned(fp: str, place: Column) -> Column:
    """The ring from a place on: bits turned left by ``4 * place``."""
    by = place * WIDTH
    turned = F.call_function("shiftleft", F.col(fp), by).bitwiseOR(
        F.call_function("shiftrightunsigned", F.col(fp), (64 - by) % 64)
    )
    return F.when(place == 0, F.col(fp)).otherwise(turned)


def _differs(a: str, b: str, segments: int) -> Column:
    """Differing bits in the first segments of two turned rings."""
    bits = F.col(a).bitwiseXOR(F.col(b))
    if segments < SEGMENTS:
        bits = F.call_function("shiftrightunsigned", bits, F.lit(64 - WIDTH * segments))
    return F.bit_count(bits)


def extra_segments(distinct: int, per_key: int = 16) -> int:
    """Segments after the equal ones to take into the key, so that random values seldom share one."""
    extra = 0
    while extra < 5 and distinct > per_key << (WIDTH * (EXACT + extra)):
        extra += 1
    return extra


def links(nodes: DataFrame, extra: int = 0) -> DataFrame:
    """Pairs ``a, b`` of different fingerprints (column ``fp``, unique) within 3 bits."""
    ring = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("place"))
    ring = ring.select("fp", "place", _turned("fp", F.col("place")).alias("turned"))
    keep = 64 - WIDTH * (EXACT + extra)
    key = F.call_function("shiftrightunsigned", F.col("turned"), F.lit(keep))
    left = ring.select("place", key.alias("key"), F.col("fp").alias("a"), F.col("turned").alias("ta"))
    right = ring.select("place", key.alias("key"), F.col("fp").alias("b"), F.col("turned").alias("tb"))
    if extra:
        flips = [0, *(1 << i for i in range(WIDTH * extra))]
        near = F.explode(F.array(*(F.col("key").bitwiseXOR(F.lit(x).cast("bigint")) for x in flips)))
        right = right.withColumn("key", near)
    pairs = left.join(right, ["place", "key"]).where(
        (F.col("a") < F.col("b"))
        & (_differs("ta", "tb", EXACT) == 0)
        & (_differs("ta", "tb", 2 * EXACT) <= 1)
        & (_differs("ta", "tb", 3 * EXACT) <= 2)
        & (_differs("ta", "tb", SEGMENTS) <= DISTANCE)
    )
    return pairs.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, fp, h``, ``root``, the group's smallest fingerprint, and ``component_id``, its smallest id."""
    prints = store(fingerprints(docs, id_col, text_col))
    nodes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes, extra_segments(nodes.count())))
    roots = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    group_of = roots.join(least, "root").select("fp", "root", "component_id")
    return prints.join(group_of, "fp").select("doc_id", "fp", "h", "root", "component_id")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None
) -> DataFrame:
    """One whole row of each group: one with the group's ``component_id``. ``groups``: `near_duplicates`, if not given."""
    if groups is None:
        groups = near_duplicates(docs, id_col, text_col)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min(F.struct("h", "doc_id")).alias("k")
    )
    kept = kept.select("k.h", "k.doc_id")
    rows = docs.select(
        F.struct("*").alias("_row"), F.xxhash64(text_col).alias("h"), F.col(id_col).alias("doc_id")
    ).alias("r")
    same = (F.col("r.h") == F.col("k.h")) & F.col("r.doc_id").eqNullSafe(F.col("k.doc_id"))
    met = rows.join(kept.alias("k"), same, "left_semi")
    return met.dropDuplicates(["doc_id", "h"]).select("_row.*")
