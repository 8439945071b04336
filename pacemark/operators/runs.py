"""Run-time reports: means, deviations, grouped medians, overhead, margins, durations, phases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.functions.stats import (
    COMPAT_RUNS,
    margin95,
    overhead_percent,
    throughput_from_rates,
)
from pacemark.operators.ordered import SLICE, Slices, key_total, running_sum, scan


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Number of runs, mean and population deviation per group."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("pstdev"),
    )


def grouped_median(
    df: DataFrame, keys: Sequence[str], value: str, slices: Slices | None = None
) -> DataFrame:
    """Median of grouped data with interval 1: exact, from the histogram of each group.

    ``slices`` (planned on the value) divides groups that have very many distinct values; without it
    each group's histogram is one window partition.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_f"))
    name = None
    if slices is not None:
        hist, name = slices.assign(hist), SLICE
    counted = scan(
        hist, keys, [value], {"_upto": running_sum(F.col("_f")), "n": key_total(F.col("_f"))}, name
    )
    below = F.col("_upto") - F.col("_f")
    half = F.call_function("div", F.col("n"), F.lit(2).cast("bigint"))
    median = F.col(value) - 0.5 + (F.col("n") / 2 - below) / F.col("_f")
    return counted.where((below <= half) & (half < F.col("_upto"))).select(
        *keys, "n", median.alias("grouped_median")
    )


def overhead(
    stats: DataFrame, baseline: Column | float, mean: str = "mean"
) -> DataFrame:
    """Add ``overhead`` in percent against a baseline run time (number or column)."""
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    return stats.withColumn("overhead", overhead_percent(base, F.col(mean)))


def overhead_to_group(
    stats: DataFrame, baseline: Column, on: Sequence[str], mean: str = "mean"
) -> DataFrame:
    """`overhead` against the group of ``stats`` picked by ``baseline``, per value of ``on``."""
    base = stats.where(baseline).select(*on, F.col(mean).alias("baseline"))
    return overhead(stats.join(base, list(on), "left"), F.col("baseline"), mean)


def margin(stats: DataFrame, compat: bool = False) -> DataFrame:
    """Add the 95 % margin and its bounds; ``compat`` always takes 20 runs."""
    half = margin95(F.col("pstdev"), COMPAT_RUNS if compat else F.col("n"))
    return stats.withColumns(
        {"margin": half, "low": F.col("mean") - half, "high": F.col("mean") + half}
    )


def durations(
    starts: DataFrame, ends: DataFrame, keys: Sequence[str], start: str, end: str
) -> DataFrame:
    """Seconds from the earliest start to the latest end per key; both sides are aggregated first."""
    a = starts.groupBy(*keys).agg(F.min(start).alias("start_s"))
    b = ends.groupBy(*keys).agg(F.max(end).alias("end_s"))
    return a.join(b, list(keys)).withColumn("seconds", F.col("end_s") - F.col("start_s"))


def phase_comparison(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    phases: tuple[str | int, str | int] = ("AF", "DF"),
    phase: str = "phase",
) -> DataFrame:
    """Mean per phase (or checkpoint period) side by side, and the second relative to the first."""
    first, second = (str(p) for p in phases)
    return (
        df.groupBy(*keys)
        .pivot(phase, list(phases))
        .agg(F.avg(value))
        .withColumnsRenamed({first: f"mean_{first.lower()}", second: f"mean_{second.lower()}"})
        .withColumn("ratio", F.col(f"mean_{second.lower()}") / F.col(f"mean_{first.lower()}"))
    )


def phase_subtotals(
    df: DataFrame,
    dims: Sequence[str],
    value: str,
    phases: tuple[str | int, str | int] = ("AF", "DF"),
    phase: str = "phase",
) -> DataFrame:
    """`phase_comparison` for all combinations of ``dims`` and all their subtotals, in one aggregation.

    ``grouping`` has a bit per dimension, the first one highest, set where the row is a total over it; so a total
    and a group whose own value is NULL are told apart.
    """
    first, second = (str(p).lower() for p in phases)
    means = [F.avg(F.when(F.col(phase) == p, F.col(value))) for p in phases]
    out = df.cube(*dims).agg(
        F.grouping_id().alias("grouping"),
        F.count(value).alias("n"),
        means[0].alias(f"mean_{first}"),
        means[1].alias(f"mean_{second}"),
    )
    return out.withColumn("ratio", F.col(f"mean_{second}") / F.col(f"mean_{first}"))


def io_summary(df: DataFrame, keys: Sequence[str], mb: str, seconds: str) -> DataFrame:
    """Throughput and I/O rate of transfer tasks: total over total, and mean and deviation of rates."""
    rate = F.col(mb) / F.col(seconds)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_tasks"),
        F.sum(mb).alias("total_mb"),
        (F.sum(mb) / F.sum(seconds)).alias("throughput"),
        F.avg(rate).alias("avg_io"),
        F.stddev_pop(rate).alias("io_std"),
    )


def io_consistent(df: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Add ``consistent``: whether a report of two equal files fits its own rates."""
    expected = throughput_from_rates(F.col("avg_io"), F.col("io_std"))
    error = F.abs(expected - F.col("throughput")) / F.col("throughput")
    return df.withColumns({"rel_error": error, "consistent": error <= tolerance})
