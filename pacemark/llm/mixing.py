"""Mixing sources to target weights by fitting subset sums of document lengths.

Targets: sources stand in code-point order, null last, with weights that repeat; they share the words of
all documents by weight, a source's target ends at ``most`` times its size, and what is beyond is shared
anew until no target is above its end.

Fit: a source whose target is k whole sizes and a rest takes every document k times and fits the rest. Its
documents are counted by exact length. Each length first gives its share of the rest, rounded down, so
that the mix looks like the source; then a bounded-knapsack dynamic program over the lengths' unused
documents finds the largest sum within the remaining budget, which is kept at a few times the longest
document. Sums are bits of one number, so an item costs one shift. The result is a number of documents per
length. These are picked in the order of a seeded hash, so reruns agree.

Rows are shuffled without their texts. A length that very many documents share is picked from by parts of
the hash range: whole parts by their counts, single rows only in the one part where the number runs out.
One task sees a source's lengths with their counts, never its documents.

Edge cases: a null or blank text has size 0, and nothing is taken from it; a source without words has
target 0. Repeated rows and null ids are rows of their own. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacemark.llm.base import numbered, store
from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

WEIGHTS, MOST, SEED = (1.0, 2.0, 3.0), 3, 29
PART_ROWS = 50_000  # rows of a length that are ordered in one task, about


def best_sum(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is as large as possible, within the budget.

    Bounded knapsack: a length's count is cut into 1, 2, 4, .. and a rest; ``reach`` has bit s set if the
    items so far can sum to s.
    """
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for i, (length, count) in enumerate(zip(lengths, counts)):
        left, size = min(count, budget // length) if length else 0, 1
        while left and not reach >> budget & 1:
            size = min(size, left)
            steps.append((i, size, reach))
            reach |= reach << size * length & mask
            left, size = left - size, size * 2
    total = reach.bit_length() - 1
    taken = [0] * len(lengths)
    for i, size, before in reversed(steps):
        if not before >> total & 1:
            taken[i] += size
            total -= size * lengths[i]
    return taken


def allot(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """Documents to take of each length (all above 0, each once) for a sum near the budget, not above it."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    share = counts * (budget / total)
    taken = np.floor(share).astype(np.int64)
    left = budget - int((taken * lengths).sum())
    few = 4 * int(lengths.max())
    order = np.lexsort((np.random.default_rng(seed).permutation(len(lengths)), taken - share))
    for i in order:  # one more of those that lost most by rounding, until a few documents' room is left
        if left <= few:
            break
        if taken[i] < counts[i]:
            taken[i] += 1
            left -= int(lengths[i])
    while left < 0 or (left < few and taken.any() and left < budget):  # leave room for a choice
        i = int(np.argmax(taken * lengths))
        taken[i] -= 1
        left += int(lengths[i])
    pick = np.random.default_rng(seed + 1).permutation(len(lengths))
    more = best_sum(lengths[pick].tolist(), (counts - taken)[pick].tolist(), left)
    taken[pick] += np.array(more, np.int64)
    return taken


def _row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text")


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size`` and a seeded hash ``h`` of id, source and text, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [len((x.as_py() or b"").split()) for x in batch.column(0)]  # splits at ASCII blanks
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(size, pa.int64())], names=["doc_id", "source", "h", "size"]
            )

    rows = docs.select(
        F.col("text").cast("binary").alias("_words"), "doc_id", "source",
        _row_hash(seed).alias("h"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(
        run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, h bigint, size bigint"
    )


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: ``source, source_size, target``."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = numbered(totals, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("pos") % len(weights) + 1).cast("int"))
    rows = store(place.select("source", "source_size", weight.alias("w"), (most * F.col("source_size")).alias("end")))
    total, all_weights = rows.agg(F.sum("source_size"), F.sum("w")).first()
    level = (total or 0) / all_weights if all_weights else 0.0
    while True:  # words per weight; rises with every source that ends, so each round ends more or none
        above = F.col("w") * level > F.col("end")
        ended, free = rows.agg(
            F.sum(F.when(above, F.col("end")).otherwise(0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))
        ).first()
        risen = (total - ended) / free if free else level
        if risen <= level:
            break
        level = risen
    return rows.select("source", "source_size", F.least(F.col("w") * level, F.col("end").cast("double")).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """Per row: ``doc_id, h, size, source_size, target, times, taken`` (words: times x size)."""
    sized = store(sizes(docs, seed))
    goal = store(targets(sized, weights, most))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    lengths = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    lengths = lengths.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        size, target = int(pdf["source_size"][0]), float(pdf["target"][0])
        whole = min(most, int(target // size))
        rest = 0 if whole >= most else int(round(target)) - whole * size
        take = allot(pdf["size"].to_numpy(), pdf["n"].to_numpy(), max(0, rest), seed)
        return pdf[["source", "size", "n"]].assign(whole=whole, take=take)

    kind = sized.schema["source"].dataType.simpleString()
    plan = store(
        lengths.groupBy("source").applyInPandas(
            fit, f"source {kind}, size bigint, n bigint, whole bigint, take bigint"
        )
    )
    largest = plan.agg(F.max("n")).first()[0] or 0
    bits = max(0, (largest // PART_ROWS).bit_length())
    part = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    planned = plan.withColumnRenamed("source", "_s").withColumnRenamed("size", "_z")
    rows = sized.join(
        planned, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left"
    ).drop("_s", "_z")
    rows = rows.withColumn("_part", part)
    some = (F.col("take") > 0) & (F.col("take") < F.col("n"))
    in_part = rows.where(some).groupBy("source", "size", "_part", "take").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    in_part = in_part.select(
        "source", "size", "_part", "_c", (F.col("take") - F.coalesce(F.sum("_c").over(upto), F.lit(0))).alias("_left")
    ).select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_part").alias("_p"), "_c", "_left"
    )
    rows = rows.join(
        in_part,
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_part") == F.col("_p")),
        "left",
    ).drop("_s", "_z", "_p")
    edge = (F.col("_left") > 0) & (F.col("_left") < F.col("_c"))
    spread = F.when(edge, F.lit(0)).otherwise(F.pmod("h", F.lit(1024)) + 1)  # others need no order
    by = Window.partitionBy("source", "size", "_part", spread).orderBy("h", "doc_id")
    picked = (
        F.when(F.col("take") == F.col("n"), 1)
        .when(F.col("_left") >= F.col("_c"), 1)
        .when(edge & (F.row_number().over(by) <= F.col("_left")), 1)
        .otherwise(0)
    )
    rows = rows.withColumn("times", F.coalesce(F.col("whole") + picked, F.lit(0)).cast("bigint"))
    goal = goal.withColumnRenamed("source", "_s")
    return rows.join(goal, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "h", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken")
    )


def take(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    times = mix(docs, weights, most, seed).groupBy("doc_id", "h").agg(
        F.sum("times").alias("_times"), F.count("*").alias("_rows")
    )
    times = times.where("_times > 0").alias("t")
    rows = docs.select(F.struct("*").alias("_row"), _row_hash(seed).alias("h"), F.col("doc_id").alias("doc_id")).alias("r")
    rows = rows.join(times, (F.col("r.h") == F.col("t.h")) & F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")))
    rows = rows.select("_row", "r.h", "r.doc_id", "_times", "_rows")
    # rows that are equal in id, source and text share their number
    nth = F.row_number().over(Window.partitionBy("h", "doc_id").orderBy(F.lit(1)))
    own = F.floor(F.col("_times") / F.col("_rows")) + (nth <= F.col("_times") % F.col("_rows")).cast("int")
    taken = rows.withColumn("_own", own).where("_own > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "_own"))).select("_row.*")
