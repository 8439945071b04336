"""Ordered lists: neighbours, batches, numbering, n-th rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacemark.operators.ordered import SLICE, previous, row_number, scan


def uniq_consecutive(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Drop rows that repeat the value of the row directly before them."""
    mark = F.struct(F.col(value).alias("x"))
    out = scan(df, keys, order, {"_prior": previous(mark)}, slice_col)
    same = F.col("_prior").isNotNull() & F.col(value).eqNullSafe(F.col("_prior.x"))
    return out.where(~same).drop("_prior")


def sequence_ids(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "myid",
    slice_col: str = SLICE,
) -> DataFrame:
    """Dense numbers from 1 along the order; rows are counted per slice, never gathered in one."""
    return scan(df, keys, order, {name: row_number()}, slice_col)


def fixed_batches(
    df: DataFrame,
    size: int,
    batches: int,
    order: Sequence[str],
    keys: Sequence[str] = (),
    slice_col: str = SLICE,
) -> DataFrame:
    """Add ``batch`` and ``place`` in it; rows after the last batch have NULL in both."""
    rows = scan(df, keys, order, {"_rn": row_number()}, slice_col)
    i = F.col("_rn") - 1
    inside = i < size * batches
    return rows.withColumns(
        {
            "batch": F.when(inside, F.floor(i / size)),
            "place": F.when(inside, i % size),
        }
    ).drop("_rn")


def batch_capacity(df: DataFrame, size: int, batches: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows available and asked for, and whether there are enough."""
    need = F.lit(size * batches).cast("bigint")
    return df.groupBy(*keys).agg(
        F.count("*").alias("available"),
        F.max(need).alias("requested"),
        (F.count("*") >= F.max(need)).alias("enough"),
    )


def nth_per_group(
    df: DataFrame, n: int | Sequence[int], keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The ``n``-th row of each group, or several of them, with their number in ``nth``.

    A group sends only as many rows as needed through the shuffle.
    """
    wanted = [n] if isinstance(n, int) else list(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= max(wanted))
    return numbered.where(F.col("nth").isin(wanted))
