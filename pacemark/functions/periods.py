"""Checkpoint periods as column expressions.

``cost``, ``mtbf`` and ``restart`` are seconds. Invalid input gives NULL, or -1 with ``compat=True``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest period in seconds, smallest change that is announced, history length,
# periods announced at start (configured run and default).
PERIOD_MINIMAL = 10
PERIOD_THRESHOLD = 5
HISTORY_LENGTH = 50
PERIOD_START = 3600
PERIOD_DEFAULT = 1000

# Total I/O rate up to the first number gives the period in the second one.
IO_STEPS = [(60, 10), (80, 36), (100, 60), (150, 120), (250, 360), (300, 400), (500, 500)]
IO_STEP_DEFAULT = 500

YOUNG, DALY = 1, 2


def _checked(valid: Column, period: Column, compat: bool) -> Column:
    good = F.when(valid, period)
    return F.coalesce(good, F.lit(-1.0)) if compat else good


def young(cost: Column, mtbf: Column, compat: bool = False) -> Column:
    """Young's first-order period, ``sqrt(2 c m)``."""
    return _checked(cost * mtbf >= 0, F.sqrt(2 * cost * mtbf), compat)


def daly_first(cost: Column, mtbf: Column, restart: Column, compat: bool = False) -> Column:
    """Daly's first-order period with restart time, ``sqrt(2 c (m + r))``."""
    total = mtbf + restart
    return _checked(cost * total >= 0, F.sqrt(2 * cost * total), compat)


def daly_high(cost: Column, mtbf: Column, compat: bool = False) -> Column:
    """Daly's higher-order period; the MTBF itself once the cost reaches twice the MTBF."""
    ratio = cost / (2 * mtbf)
    series = 1 + F.sqrt(ratio) / 3 + ratio / 9
    inner = F.when(cost * mtbf >= 0, F.sqrt(2 * mtbf * cost) * series - cost)
    period = F.when(cost >= 2 * mtbf, mtbf).otherwise(inner)
    return _checked(period.isNotNull(), period, compat)


def daly_high_compat(cost: Column, mtbf: Column, compat: bool = False) -> Column:
    """Daly's period as older installations compute it: integer division leaves ``sqrt(2mc) - c``."""
    inner = F.when(cost * mtbf >= 0, F.sqrt(2 * mtbf * cost) - cost)
    period = F.when(cost >= 2 * mtbf, mtbf).otherwise(inner)
    return _checked(period.isNotNull(), period, compat)


def period_by_policy(policy: Column, cost_ms: Column, mtbf: Column, compat: bool = False) -> Column:
    """Whole seconds by the chosen policy: 1 is Young, anything else Daly. The cost is in ms."""
    cost = cost_ms / 1000.0
    daly = daly_high_compat(cost, mtbf) if compat else daly_high(cost, mtbf)
    return F.when(policy == YOUNG, young(cost, mtbf)).otherwise(daly).cast("bigint")


def valid_period(period: Column, minimal: int = PERIOD_MINIMAL) -> Column:
    """NULL for negative periods, otherwise at least ``minimal``."""
    return F.when(period >= 0, F.greatest(period, F.lit(minimal).cast("bigint")))


def step_period(
    total: Column, steps: Sequence[tuple[int, int]] = IO_STEPS, default: int = IO_STEP_DEFAULT
) -> Column:
    """Period of the smallest threshold that is not below ``total``.

    Above the largest threshold, and for negative totals, it is the default. Meant for short tables:
    it becomes one chain of comparisons.
    """
    chain = F.when(total < 0, default)
    for threshold, period in sorted(steps):
        chain = chain.when(total <= threshold, period)
    return chain.otherwise(F.when(total.isNotNull(), default)).cast("int")


def first_order_waste(cost: Column, mtbf: Column, period: Column) -> Column:
    """Share of time lost under Young's model: ``c / p + p / (2 m)``."""
    return cost / period + period / (2 * mtbf)
