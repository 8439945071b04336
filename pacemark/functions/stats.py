"""Report figures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal quantile for 95 %, number of repetitions in the compatible margin.
Z95 = 1.96
COMPAT_RUNS = 20


def overhead_percent(baseline: Column, mean: Column) -> Column:
    """Run time added over the baseline in percent of the mean; negative when faster."""
    return 100 - baseline * 100.0 / mean


def margin95(pstdev: Column, n: Column | int = COMPAT_RUNS) -> Column:
    """Half width of the 95 % interval around a mean of ``n`` runs."""
    return Z95 * pstdev / F.sqrt(F.lit(n) if isinstance(n, int) else n)


def floor_div(a: Column, b: Column) -> Column:
    """Exact integer division rounding down, NULL for a zero divisor."""
    divisor = F.nullif(b, F.lit(0).cast("bigint"))
    cut = F.call_function("div", a, divisor)  # towards zero
    below = (a % divisor != 0) & ((a < 0) != (divisor < 0))
    return cut - F.when(below, 1).otherwise(0)


def throughput_from_rates(mean_rate: Column, rate_std: Column) -> Column:
    """Throughput of two equal-sized files, given mean and deviation of their rates."""
    return (mean_rate * mean_rate - rate_std * rate_std) / mean_rate
