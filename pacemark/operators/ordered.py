"""Ordered operators that keep working when one key holds a large share of all rows.

A window ``partitionBy(key).orderBy(ts, id)`` puts all rows of a key into one task. Here the order is
first divided into slices of about equal size (`Slices`), windows run per ``(key, slice)``, and a
small table with at most one row per key and slice carries the result of earlier slices into later
ones (`scan`). Frames of a fixed number of rows (`last_n`) run over blocks of a dense sequence number,
each block seeing the last rows of the block before it.

Where the slices are cut affects only balance, never results.
Rows with a NULL key form a key of their own, as in a grouping. Order columns must not be NULL and must
be unique together per key.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLICE = "slice"
PLAN = "slices"  # in the metadata of a slice column
ROWS_PER_SLICE = 2_000_000
MIN_SLICES = 4
MAX_SLICES = 20_000
SAMPLES_PER_SLICE = 20


@dataclass(frozen=True)
class Slices:
    """Cut points in the order ``(first, second)``; both order columns are numeric."""

    order: tuple[str, str]
    cuts: tuple[tuple[float, float], ...] = field(repr=False)

    @staticmethod
    def plan(
        df: DataFrame,
        order: Sequence[str],
        rows_per_slice: int = ROWS_PER_SLICE,
        min_slices: int = MIN_SLICES,
    ) -> "Slices":
        """Choose cut points from a sample of at most about 20 rows per slice.

        The number of slices grows with the table up to ``MAX_SLICES``, so the sample that reaches the
        driver has a fixed upper size. Only the order columns are read.
        """
        first, second = (order[0], order[-1])
        rows = df.count()
        n = max(min_slices, min(MAX_SLICES, rows // rows_per_slice))
        fraction = min(1.0, SAMPLES_PER_SLICE * n / max(rows, 1))
        keys = df.select(F.col(first).cast("double"), F.col(second).cast("double"))
        if fraction < 1.0:
            keys = keys.sample(withReplacement=False, fraction=fraction, seed=17)
        sample = sorted((r[0], r[1]) for r in keys.collect())
        step = len(sample) / n
        cuts = sorted({sample[int(i * step)] for i in range(1, n)}) if sample else []
        return Slices((first, second), tuple(cuts))

    def assign(self, df: DataFrame, name: str = SLICE) -> DataFrame:
        """Add the slice number of each row; slices are numbered along the order.

        The column's metadata tell the plan, so that rows of different plans are not mixed (`same_plan`).
        """
        plan = f"{zlib.crc32(repr((self.order, self.cuts)).encode()):08x}"
        return self._numbered(df, name).withMetadata(name, {PLAN: plan})

    def _numbered(self, df: DataFrame, name: str) -> DataFrame:
        first, second = self.order
        if not self.cuts:
            return df.withColumn(name, F.lit(0).cast("bigint"))
        splits = sorted({c[0] for c in self.cuts})
        raw = "_slice_first"
        df = Bucketizer(
            splits=[float("-inf"), *splits, float("inf")], inputCol=first, outputCol=raw
        ).transform(df)
        # the ML attribute on the column is of no use here and would end up in written files
        bucket = F.col(raw).cast("bigint")
        repeats = Counter(c[0] for c in self.cuts)
        width = max(repeats.values()) + 2
        if width == 3:
            return df.withColumn(name, bucket).drop(raw)
        # A value of the first column with several cuts is split further along the second column.
        pieces = []
        for value in (v for v, n in repeats.items() if n > 1):
            bounds = [float("-inf"), *(c[1] for c in self.cuts if c[0] == value), float("inf")]
            pieces += [(value, lo, hi, i) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))]
        hot = df.sparkSession.createDataFrame(
            pieces, "_hot double, _lo double, _hi double, _hot_piece bigint"
        )
        a, b = F.col(first).cast("double"), F.col(second).cast("double")
        joined = df.join(
            F.broadcast(hot),  # at most MAX_SLICES rows
            (a == F.col("_hot")) & (b >= F.col("_lo")) & (b < F.col("_hi")),
            "left",
        )
        number = bucket * width + F.coalesce("_hot_piece", F.lit(width - 1))
        return joined.withColumn(name, number).drop(raw, "_hot", "_lo", "_hi", "_hot_piece")


def same_plan(*tables: DataFrame, slice_col: str = SLICE) -> None:
    """Refuse tables whose slice numbers are known to come from different plans."""
    plans = {t.schema[slice_col].metadata.get(PLAN) for t in tables} - {None}
    if len(plans) > 1:
        raise ValueError(f"{slice_col} was numbered by {len(plans)} plans; assign one to all inputs")


@dataclass(frozen=True)
class Carry:
    """One running value: how it is computed in a slice, summed up for it, and carried over."""

    local: Callable[[WindowSpec], Column]
    total: Callable[[Column], Column]
    carried: Callable[[Column, WindowSpec], Column]
    finish: Callable[[Column, Column], Column]
    alone: Callable[[WindowSpec], Column] = lambda w: F.lit(None)  # carried value without slices


def _rows(w: WindowSpec, last: int) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, last)


def running_sum(x: Column) -> Carry:
    """Sum of ``x`` over all rows of the key up to and including the current one."""
    return Carry(
        local=lambda w: F.sum(x).over(_rows(w, 0)),
        total=lambda order: F.sum(x),
        carried=lambda t, w: F.sum(t).over(_rows(w, -1)),
        finish=lambda here, before: F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)),
    )


def row_number() -> Carry:
    """1-based position of the row in its key."""
    return running_sum(F.lit(1).cast("bigint"))


def running_max(x: Column, before: bool = False) -> Carry:
    """Largest ``x`` of the key, up to the current row or strictly before it."""
    return Carry(
        local=lambda w: F.max(x).over(_rows(w, -1 if before else 0)),
        total=lambda order: F.max(x),
        carried=lambda t, w: F.max(t).over(_rows(w, -1)),
        finish=lambda here, prior: F.greatest(here, prior),
    )


def last_known(x: Column, before: bool = False) -> Carry:
    """Latest non-NULL ``x`` of the key, up to the current row or strictly before it."""
    return Carry(
        local=lambda w: F.last(x, ignorenulls=True).over(_rows(w, -1 if before else 0)),
        total=lambda order: F.max_by(x, F.when(x.isNotNull(), order)),
        carried=lambda t, w: F.last(t, ignorenulls=True).over(_rows(w, -1)),
        finish=lambda here, prior: F.coalesce(here, prior),
    )


def previous(x: Column) -> Carry:
    """``x`` of the row directly before, NULL for the first row of the key."""
    boxed = F.struct(x.alias("v"))
    return Carry(
        local=lambda w: F.lag(boxed).over(w),
        total=lambda order: F.max_by(boxed, order),
        carried=lambda t, w: F.lag(t).over(w),
        finish=lambda here, prior: F.coalesce(here, prior)["v"],
    )


def key_total(x: Column) -> Carry:
    """Sum of ``x`` over all rows of the key."""
    return Carry(
        local=lambda w: F.lit(0),
        total=lambda order: F.sum(x),
        carried=lambda t, w: F.sum(t).over(
            w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
        finish=lambda here, whole: whole,
        alone=lambda w: F.sum(x).over(
            w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
    )


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, Carry],
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Add running columns over all rows of each key in the given order.

    With ``slice_col=None`` these are plain windows per key: one shuffle, right where keys are many
    and none is large. With a slice column, the rows are shuffled once by ``(keys, slice)``; the
    carry table is aggregated map-side and has at most one row per key and slice. Both are joined by
    the keys in one struct, which is equal to another one where both have NULL in a key.
    """
    if slice_col is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: c.finish(c.local(w), c.alone(w)) for n, c in columns.items()})
    coded = ["_key"] if keys else []
    parts = [*coded, slice_col]
    kept = [c for c in df.columns if c not in columns]
    position = F.struct(*order)
    if keys:
        df = df.withColumn("_key", F.struct(*keys))
    w = Window.partitionBy(*parts).orderBy(*order)
    over_slices = Window.partitionBy(*coded).orderBy(slice_col)
    totals = df.groupBy(*parts).agg(
        *[c.total(position).alias(f"_t_{name}") for name, c in columns.items()]
    )
    carry = totals.select(
        *parts,
        *[c.carried(F.col(f"_t_{n}"), over_slices).alias(f"_c_{n}") for n, c in columns.items()],
    )
    local = df.select("*", *[c.local(w).alias(f"_l_{n}") for n, c in columns.items()])
    # an inner join: both branches then read the input with the same filters and share its shuffle
    return local.join(carry, parts).select(
        *kept,
        *[c.finish(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, c in columns.items()],
    )


def last_n(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    n: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    block: int = 65_536,
) -> DataFrame:
    """Aggregates over the last ``n`` rows of each key, by its dense sequence number.

    Every block of ``block`` rows is its own window partition. The last ``n - 1`` rows of a block are
    also sent to the next one, where they fill the frames and are dropped afterwards.
    """
    block = max(block, n)
    home = F.floor(F.col(seq) / block)
    near_end = F.col(seq) % block >= block - (n - 1)
    copies = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_block", F.explode(copies))
    w = Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(1 - n, 0)
    return spread.withColumns(columns(w)).where(F.col("_block") == home).drop("_block")
