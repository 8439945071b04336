"""Exact top-k by inner product: columnar branch-and-bound.

Components become ``floor(1024 * x)``, so scores are whole numbers. A block of candidates lies in vertical
layout, dimension blocks by candidates. The dimensions are taken block by block; after each, a candidate's
partial score plus the most that the rest can add, the product of the remaining lengths of query and candidate
(Cauchy-Schwarz), bounds its score from above. Candidates below the k-th best lower bound of the query are
dropped and the survivors are compacted, so later dimension blocks touch few. Dimensions are taken in the order
of their mass in the queries. Bounds are rounded outwards, and a tie is never dropped.

Queries and candidates meet in blocks of bounded size: a query block is sent to every candidate block, and the
k best of each pair of blocks meet in a grouping by query. Every stated query is held against every other row.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do null ids. Only
vectors of equal length are compared; empty ones score 0. Scores beyond BIGINT end at its limits. Repeated rows
are candidates each; a query's own rows are those with its id. An id that occurs more than once among the
queries is asked once, with its smallest vector. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacemark.llm.base import store
from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

SCALE, K = 1024, 10
QUERY_ROWS, CANDIDATE_ROWS = 1_024, 8_192  # rows of a block, about
DIMENSIONS = 8  # of a block
LIMIT = (1 << 63) - 1


def usable(vector: str) -> Column:
    """Not null, and every component is a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole_numbers(vectors: pd.Series) -> np.ndarray:
    """Rows of floor(1024 * x); exact, as Python's numbers where a score could leave BIGINT."""
    x = np.floor(SCALE * np.array([np.asarray(v, np.float64) for v in vectors]))
    if x.size and np.abs(x).max() ** 2 * x.shape[1] >= 2**62:
        exact = [[int(SCALE * 2**60 * c) // 2**60 if abs(c) < 1 else int(SCALE * c) for c in row] for row in x / SCALE]
        return np.array(exact, object)
    return x.astype(np.int64)


def best_of_block(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int = K):
    """Yields query id, candidate ids and scores of the k best, ties to the smaller id."""
    if queries.dtype == object or rows.dtype == object:
        queries, rows = queries.astype(object), rows.astype(object)
        for q, q_id in zip(queries, q_ids):
            other = np.flatnonzero(ids != q_id)
            scores = [min(LIMIT, max(-LIMIT - 1, sum(a * b for a, b in zip(q, rows[i])))) for i in other]
            top = sorted(zip(scores, ids[other].tolist()), key=lambda x: (-x[0], x[1]))[:k]
            yield q_id, [i for _, i in top], [s for s, _ in top]
        return
    width = queries.shape[1]
    mass = np.argsort(-(queries.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    blocks = [mass[i : i + DIMENSIONS] for i in range(0, width, DIMENSIONS)]
    columns = [np.ascontiguousarray(rows[:, b].T) for b in blocks]  # vertical: one line per dimension

    def rests(x: np.ndarray) -> list[np.ndarray]:
        squares = [(x[:, b].astype(np.float64) ** 2).sum(axis=1) for b in blocks]
        return [np.sqrt(sum(squares[i + 1 :], np.zeros(len(x)))) * (1 + 1e-12) for i in range(len(blocks))]

    row_rest, query_rest = rests(rows), rests(queries)
    for n, (q, q_id) in enumerate(zip(queries, q_ids)):
        alive = np.flatnonzero(ids != q_id)
        partial = np.zeros(len(alive), np.int64)
        for i, b in enumerate(blocks):
            part = columns[i] if len(alive) == len(rows) else columns[i][:, alive]
            partial = partial + q[b] @ part
            if i + 1 < len(blocks) and len(alive) > k:
                most = row_rest[i][alive] * query_rest[i][n] + 1
                low = partial - most
                bar = np.partition(low, len(low) - k)[len(low) - k]
                keep = partial + most >= bar
                alive, partial = alive[keep], partial[keep]
        top = np.lexsort((ids[alive], -partial))[:k]
        yield q_id, ids[alive[top]].tolist(), partial[top].tolist()


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_rows: int = QUERY_ROWS,
    candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """Per query: ``query_id, rank, vec_id, score`` of its k best rows; ``is_query`` is a condition on ``id``."""
    fit = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    )
    rows = store(fit.withColumn("width", F.size("v")))
    asked = rows.where(is_query).groupBy("width", "id").agg(F.min("v").alias("v"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("width"))
    asked = store(asked.withColumn("_first", first).where("_first = 1").drop("_first"))
    n_rows, n_asked = rows.count(), asked.count()
    row_blocks, query_blocks = -(-n_rows // candidate_rows) or 1, -(-n_asked // query_rows) or 1
    h = F.xxhash64(F.lit(5), "id")
    left = asked.select(
        "width", F.pmod(h, F.lit(query_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(row_blocks - 1).cast("bigint"))).alias("rb"), "id", "v",
    )
    right = rows.select(
        "width",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))).alias("qb"),
        F.pmod(F.xxhash64(F.lit(6), "id", "v"), F.lit(row_blocks)).alias("rb"), "id", "v",
    )

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(r):
            best = best_of_block(
                whole_numbers(q["v"]), q["id"].to_numpy(), whole_numbers(r["v"]), r["id"].to_numpy(), k
            )
            found = [(a, i, s) for a, ids, scores in best for i, s in zip(ids, scores)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    key = ["width", "qb", "rb"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        meet, "query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
