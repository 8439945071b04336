"""From averages and totals to announced checkpoint periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.functions.periods import (
    DALY,
    HISTORY_LENGTH,
    IO_STEP_DEFAULT,
    IO_STEPS,
    PERIOD_START,
    PERIOD_THRESHOLD,
    YOUNG,
    first_order_waste,
    period_by_policy,
    step_period,
    valid_period,
)
from pacemark.operators.history import history_avg, number
from pacemark.operators.hysteresis import announce
from pacemark.operators.ordered import (
    SLICE,
    Slices,
    last_known,
    previous,
    row_number,
    same_plan,
    scan,
)
from pacemark.operators.telemetry import CLUSTER, ORDER, UPDATE, io_total
from pacemark.session import cut

COST, MTBF = "checkpoint", "mtbf"


def observe(
    rows: DataFrame,
    cluster: Sequence[str] = CLUSTER,
    order: Sequence[str] = ORDER,
    slice_col: str = SLICE,
) -> DataFrame:
    """Cost rows (``series`` checkpoint, ``value`` in ms) and failure rows (``series`` mtbf, ``t`` in s)
    as observations with ``value`` and ``seq``.

    The value of a failure is the time since the one before; the first one gives no observation.
    """
    keys = [*cluster, "series"]
    gap = F.col("t") - F.col("_prior")
    is_gap = F.col("series") == MTBF
    numbered = scan(
        rows, keys, order, {"_prior": previous(F.col("t")), "_rn": row_number()}, slice_col
    )
    return (
        numbered.where(~is_gap | F.col("_prior").isNotNull())
        .withColumns(
            {
                "value": F.when(is_gap, gap).otherwise(F.col("value")),
                "seq": F.col("_rn") - F.when(is_gap, 2).otherwise(1),
            }
        )
        .select(*keys, *order, slice_col, "seq", "value")
    )


def observe_carried(
    costs: DataFrame,
    carried: DataFrame,
    cluster: Sequence[str] = CLUSTER,
    order: Sequence[str] = ORDER,
    slice_col: str = SLICE,
) -> DataFrame:
    """Observations of costs (``value`` in ms) and of times between failures that carry interruptions.

    ``carried`` comes from `history.tbf_carry_last` or `tbf_carry_accumulate`, where the first failure
    counts from the START before it; its ``value`` is in seconds.
    """
    columns = [*cluster, *order, slice_col, "value"]
    both = costs.select(*columns, F.lit(COST).alias("series")).unionByName(
        carried.select(*columns, F.lit(MTBF).alias("series"))
    )
    return number(both, [*cluster, "series"], order, slice_col)


def averages(
    observations: DataFrame,
    n: int = HISTORY_LENGTH,
    cluster: Sequence[str] = CLUSTER,
    order: Sequence[str] = ORDER,
    slice_col: str = SLICE,
) -> DataFrame:
    """Current mean cost (ms) and mean time between failures (s) after every observation.

    Each row keeps its ``series``; a mean is NULL as long as its series has no observation.
    """
    means = history_avg(observations, n, [*cluster, "series"])
    series, mean = F.col("series"), F.col("avg_value")
    return scan(
        means.select(*cluster, *order, slice_col, "series", "avg_value"),
        cluster,
        order,
        {
            "avg_cost": last_known(F.when(series == COST, mean)),
            "avg_mtbf": last_known(F.when(series == MTBF, mean)),
        },
        slice_col,
    ).drop("avg_value")


def candidates(
    means: DataFrame, policy: Column | int = YOUNG, compat: bool = False
) -> DataFrame:
    """Add the valid ``period`` of each row; rows without both means or with an invalid one go.

    ``policy`` may be a column, so several policies can be compared in one pass.
    """
    chosen = F.lit(policy) if isinstance(policy, int) else policy
    raw = period_by_policy(chosen, F.col("avg_cost"), F.col("avg_mtbf"), compat)
    return means.withColumn("period", valid_period(raw)).where(F.col("period").isNotNull())


def without_repeats(
    df: DataFrame,
    value: str = "period",
    start: int | None = None,
    keys: Sequence[str] = CLUSTER,
    order: Sequence[str] = ORDER,
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Rows whose value differs from the row before; the first row is compared with ``start``."""
    out = scan(df, keys, order, {"_prior": previous(F.col(value))}, slice_col)
    prior = F.col("_prior") if start is None else F.coalesce("_prior", F.lit(start))
    return out.where(~F.col(value).eqNullSafe(prior)).drop("_prior")


def io_period(
    totals: DataFrame,
    steps: Sequence[tuple[int, int]] = IO_STEPS,
    default: int = IO_STEP_DEFAULT,
) -> DataFrame:
    """Add the ``period`` the step table gives for ``total``."""
    return totals.withColumn("period", step_period(F.col("total"), steps, default))


def io_candidates(messages: DataFrame, slice_col: str = SLICE) -> DataFrame:
    """Step-table period at every accepted ``UPDATE``; other messages change the total only."""
    totals = io_total(messages, slice_col=slice_col)
    return io_period(totals.where((F.col("verb") == UPDATE) & F.col("accepted")))


def step_period_join(
    totals: DataFrame,
    steps: DataFrame,
    default: int,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """`io_period` for a step table of any length given as rows ``threshold``, ``period``.

    Steps and totals are merged in one descending order, where each total takes the period of the step
    before it. Totals keep their type: 60.5 is above a threshold of 60. Of several periods for one
    threshold the shortest counts; rows without threshold or period are no steps.
    """
    kind = "double" if dict(totals.dtypes)["total"] in ("double", "float") else "decimal(38,6)"
    steps = (
        steps.where(F.col("threshold").isNotNull() & F.col("period").isNotNull())
        .groupBy("threshold")
        .agg(F.min("period").alias("period"))
    )
    marked = totals.withColumns(
        {
            "_down": F.coalesce(-F.col("total").cast(kind), F.lit(0).cast(kind)),
            "_side": F.lit(1),
            "period": F.lit(None).cast("int"),
        }
    )
    merged = marked.unionByName(
        steps.select(
            (-F.col("threshold").cast(kind)).alias("_down"),
            F.lit(0).alias("_side"),
            F.col("period").cast("int").alias("period"),
            *[F.lit(0).cast(totals.schema[c].dataType).alias(c) for c in order],
        ),
        allowMissingColumns=True,
    )
    along = ["_down", "_side", *order]
    sliced = Slices.plan(merged, ("_down", order[-1])).assign(merged, "_piece")
    out = scan(sliced, [], along, {"_known": last_known(F.col("period"))}, "_piece")
    known = F.coalesce(F.when(F.col("total") >= 0, F.col("_known")), F.lit(default))
    period = F.when(F.col("total").isNotNull(), known)
    found = out.where(F.col("_side") == 1).withColumn("period", period)
    return found.select(*totals.columns, "period")


def dead_band(
    df: DataFrame,
    start: int | str = PERIOD_START,
    threshold: int = PERIOD_THRESHOLD,
    keys: Sequence[str] = CLUSTER,
    order: Sequence[str] = ORDER,
    slice_col: str = SLICE,
) -> DataFrame:
    """Candidates at least ``threshold`` away from the last announced period."""
    return announce(df, keys, order, "period", threshold, start, slice_col=slice_col)


def controller(
    io: DataFrame,
    computed: DataFrame,
    start: int | str = PERIOD_START,
    threshold: int = PERIOD_THRESHOLD,
    dynamic: bool | Column = True,
    keys: Sequence[str] = CLUSTER,
    order: Sequence[str] = ORDER,
    slice_col: str = SLICE,
) -> DataFrame:
    """Announcements where the step table and the period formula share one current period.

    Step periods are announced on any difference, computed ones outside the dead-band and only if
    ``dynamic``, which may be a condition on the computed rows, such as one per cluster. At the same
    order values the step period comes first. Both inputs need slice numbers of one plan.
    """
    same_plan(io, computed, slice_col=slice_col)
    extra = [start] if isinstance(start, str) else []
    columns = [*keys, *order, slice_col, *extra]
    period = F.col("period").cast("bigint").alias("period")
    merged = io.select(*columns, period, F.lit(0).alias("kind"))
    if isinstance(dynamic, Column):
        computed = computed.where(F.coalesce(dynamic, F.lit(False)))
    if isinstance(dynamic, Column) or dynamic:
        merged = merged.unionByName(computed.select(*columns, period, F.lit(1).alias("kind")))
    merged = merged.withColumn("_io", F.col("kind") == 0)
    out = announce(merged, keys, [*order, "kind"], "period", threshold, start, "_io", slice_col)
    return out.drop("any_change")


def gated(computed: DataFrame, dynamic: Column) -> DataFrame:
    """Static clusters keep their averages but get no recommended period (NULL)."""
    return computed.withColumn("period", F.when(dynamic, F.col("period")))


def policy_rows(means: DataFrame) -> DataFrame:
    """Each row once per policy, in the column ``policy``."""
    return means.withColumn("policy", F.explode(F.array(F.lit(YOUNG), F.lit(DALY))))


def compare_policies(
    means: DataFrame,
    start: int = PERIOD_START,
    threshold: int = PERIOD_THRESHOLD,
    cluster: Sequence[str] = CLUSTER,
    order: Sequence[str] = ORDER,
    slice_col: str = SLICE,
) -> DataFrame:
    """Announcements, mean announced period and mean first-order waste per cluster and policy."""
    keys = [*cluster, "policy"]
    rows = candidates(policy_rows(cut(means)), F.col("policy"))
    said = dead_band(rows, start, threshold, keys, order, slice_col)
    emits = said.groupBy(*keys).agg(
        F.count("*").alias("emits"), F.avg("period").alias("mean_period")
    )
    waste = rows.groupBy(*keys).agg(
        F.count("*").alias("n_candidates"),
        F.avg(
            first_order_waste(F.col("avg_cost") / 1000.0, F.col("avg_mtbf"), F.col("period"))
        ).alias("mean_waste"),
    )
    return waste.join(emits, keys, "left")
