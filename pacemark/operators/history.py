"""Observation histories: ring of the last N values, averages, times between failures.

An observation row has the key columns (``cluster``, ``series``), the order columns and a whole-number
``value``. The ring pointer of the store is the dense sequence number of the observation modulo N.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacemark.functions.periods import HISTORY_LENGTH
from pacemark.operators.ordered import (
    SLICE,
    last_known,
    last_n,
    previous,
    row_number,
    running_sum,
    scan,
)
from pacemark.operators.telemetry import CLUSTER, ORDER
from pacemark.session import cut

SERIES = ("cluster", "series")
START, STOP, FAIL = "START", "STOP", "FAIL"


def whole(value: Column) -> Column:
    """Value as stored: number or numeric text, cut towards zero; NULL for anything else."""
    return value.try_cast("double").try_cast("bigint")


def number(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Add ``seq``, the 0-based position of the observation in its series."""
    return scan(df, keys, order, {"_rn": row_number()}, slice_col).withColumn(
        "seq", F.col("_rn") - 1
    ).drop("_rn")


def ring_slots(
    df: DataFrame,
    n: int = HISTORY_LENGTH,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    slice_col: str | None = SLICE,
    first_slot: int = 0,
) -> DataFrame:
    """Add ``slot``, where the ring of ``n`` places stores the observation.

    ``first_slot`` is 1 where the series node already held a zero when the first value came.
    """
    return number(df, keys, order, slice_col).withColumn(
        "slot", ((F.col("seq") + first_slot) % n).cast("int")
    )


def ring_current(
    df: DataFrame,
    n: int = HISTORY_LENGTH,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Content of the ring: the last ``n`` observations of each series with their ``slot``.

    The slot follows from ``seq`` where the observations have it, else from their number.

    The row-number limit is applied before the shuffle, so a series sends at most ``n`` rows per task.
    """
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    last = df.withColumn("_age", F.row_number().over(latest)).where(F.col("_age") <= n)
    if "seq" in df.columns:
        return last.withColumn("slot", (F.col("seq") % n).cast("int")).drop("_age")
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return (
        last.join(counts, list(keys))
        .withColumn("slot", ((F.col("_n") - F.col("_age")) % n).cast("int"))
        .drop("_age", "_n")
    )


def history_avg(
    df: DataFrame,
    n: int = HISTORY_LENGTH,
    keys: Sequence[str] = SERIES,
    value: str = "value",
    name: str = "avg_value",
    seq: str = "seq",
) -> DataFrame:
    """Add the mean of the last ``n`` observations, the current one included (needs ``seq``)."""
    return last_n(df, keys, seq, n, lambda w: {name: F.avg(value).over(w)})


def tbf_simple(
    df: DataFrame,
    t: str = "t",
    keys: Sequence[str] = CLUSTER,
    order: Sequence[str] = ORDER,
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Seconds since the previous failure as ``value``, numbered by ``seq``, for failure rows.

    The first failure of a key has no predecessor and gives no observation.
    """
    out = scan(
        df, keys, order, {"_prior": previous(F.col(t)), "_rn": row_number()}, slice_col
    ).where(F.col("_prior").isNotNull())
    return out.withColumns(
        {"value": F.col(t) - F.col("_prior"), "seq": F.col("_rn") - 2}
    ).drop("_prior", "_rn")


def _lifecycle(
    df: DataFrame, t: str, keys: Sequence[str], order: Sequence[str], slice_col: str | None
) -> DataFrame:
    """START, STOP and FAIL rows with the state and the time of the row before.

    A failure counts only while the supervisor runs; then the row before it is a START or another
    counted failure, so the time since that row is the time since the last anchor.
    """
    verb = F.col("verb")
    rows = df.where(verb.isin(START, STOP, FAIL))
    entry = F.when(verb.isin(START, STOP), verb)
    out = scan(
        rows,
        keys,
        order,
        {"_before": last_known(entry, before=True), "_prior": previous(F.col(t))},
        slice_col,
    )
    up = F.coalesce(F.col("_before") == START, F.lit(False))
    return out.withColumns({"_up": up, "_fails": up & (verb == FAIL)}).drop("_before")


def tbf_carry_last(
    df: DataFrame,
    t: str = "t",
    keys: Sequence[str] = CLUSTER,
    order: Sequence[str] = ORDER,
    slice_col: str | None = SLICE,
    keep_nonpositive: bool = False,
) -> DataFrame:
    """Times between failures where a stop stores the time since the anchor and overwrites the last.

    The stored time counts for the next failure only. A second STOP computes it again from the same
    anchor. Stored times of zero or less are ignored unless ``keep_nonpositive``.
    """
    verb = F.col("verb")
    base = _lifecycle(df, t, keys, order, slice_col)
    anchor = F.when((verb == START) | F.col("_fails"), F.col(t))
    anchored = cut(
        scan(base, keys, order, {"_tslf": last_known(anchor, before=True)}, slice_col)
    )
    elapsed = F.col(t) - F.col("_tslf")
    stored = F.when(F.col("_fails"), F.lit(0).cast("bigint")).when(
        (verb == STOP) & (F.lit(True) if keep_nonpositive else elapsed > 0), elapsed
    )
    out = scan(anchored, keys, order, {"_tebi": last_known(stored, before=True)}, slice_col)
    return (
        out.where("_fails")
        .withColumn("value", elapsed + F.coalesce("_tebi", F.lit(0)))
        .drop("_up", "_fails", "_prior", "_tslf", "_tebi")
    )


def tbf_carry_accumulate(
    df: DataFrame,
    t: str = "t",
    keys: Sequence[str] = CLUSTER,
    order: Sequence[str] = ORDER,
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Times between failures as the sum of all running time since the last counted failure.

    Running time passes from a START or counted failure to the following STOP or failure. A START
    always begins anew; a second STOP adds nothing.
    """
    base = _lifecycle(df, t, keys, order, slice_col)
    runs = F.when(
        F.col("_up") & (F.col("verb") != START), F.col(t) - F.col("_prior")
    ).otherwise(0)
    clock = cut(
        scan(base, keys, order, {"_clock": running_sum(runs)}, slice_col).where("_fails")
    )
    out = scan(clock, keys, order, {"_last": previous(F.col("_clock"))}, slice_col)
    return out.withColumn("value", F.col("_clock") - F.coalesce("_last", F.lit(0))).drop(
        "_up", "_fails", "_prior", "_clock", "_last"
    )


def restore(
    seeds: DataFrame,
    live: DataFrame,
    n: int = HISTORY_LENGTH,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Observations going on after a restart: ring content of a snapshot, then the live rows.

    ``seeds`` holds ``slot``, ``value`` and the ring ``pointer`` of each series. The slot after the
    pointer is the oldest. Adds ``restored`` and ``seq``; seed rows have negative order values. ``seq``
    goes on from the pointer, so ``seq % n`` is the slot in the stored ring.
    """
    age = F.pmod(F.col("slot") - F.col("pointer") - 1, F.lit(n))
    first, second = order[0], order[-1]
    seeded = seeds.select(
        *keys,
        (age - n).cast("bigint").alias(first),
        *([(age - n).cast("bigint").alias(second)] if second != first else []),
        F.col("value").cast("bigint").alias("value"),
        F.lit(True).alias("restored"),
        *([F.lit(-1).cast("bigint").alias(slice_col)] if slice_col else []),
    )
    columns = seeded.columns
    going_on = live.withColumn("restored", F.lit(False)).select(*columns)
    numbered = number(seeded.unionByName(going_on), keys, order, slice_col)
    # the newest seed has the pointer's slot
    first = seeds.groupBy(*keys).agg(
        F.pmod(F.max("pointer") - F.count("*") + 1, F.lit(n)).cast("bigint").alias("_first")
    )
    first = first.select(F.struct(*keys).alias("_series"), "_first")
    known = numbered.join(first, F.struct(*keys) == F.col("_series"), "left").drop("_series")
    return known.withColumn("seq", F.col("seq") + F.coalesce("_first", F.lit(0))).drop("_first")


def failure_clock(
    df: DataFrame, t: str = "t", keys: Sequence[str] = CLUSTER, order: Sequence[str] = ORDER
) -> DataFrame:
    """Where the clock of `tbf_carry_last` stands after all rows of a key: ``anchor, elapsed, running``.

    ``anchor`` is the last START or counted failure, ``elapsed`` what the last STOP stored since then.
    """
    verb = F.col("verb")
    base = _lifecycle(df, t, keys, order, SLICE)
    anchor = F.when((verb == START) | F.col("_fails"), F.col(t))
    known = scan(base, keys, order, {"_tslf": last_known(anchor, before=True)})
    gone = F.col(t) - F.col("_tslf")
    stored = F.when(F.col("_fails"), F.lit(0).cast("bigint")).when((verb == STOP) & (gone > 0), gone)
    at = F.struct(*order)
    return known.groupBy(*keys).agg(
        F.max_by(anchor, F.when(anchor.isNotNull(), at)).alias("anchor"),
        F.coalesce(F.max_by(stored, F.when(stored.isNotNull(), at)), F.lit(0)).alias("elapsed"),
        F.coalesce(
            F.max_by(verb == START, F.when(verb.isin(START, STOP), at)), F.lit(False)
        ).alias("running"),
    )


def restored_period(value: Column, default: int = 0) -> Column:
    """Announced period of a snapshot; text that is no whole number counts as zero."""
    return F.coalesce(value.try_cast("bigint"), F.lit(default))


def value_at(
    points: DataFrame,
    observations: DataFrame,
    value: str,
    keys: Sequence[str] = CLUSTER,
    order: Sequence[str] = ORDER,
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Latest ``value`` of the observations at each point (as-of), NULL before the first one.

    Both sides are merged in one order, so no pairs are formed. An observation with the same order
    values as a point counts for it.
    """
    extra = [slice_col] if slice_col else []
    common = [*keys, *order, *extra]
    side = F.lit(0).alias("_side")
    observed = observations.select(*common, value, side)
    asked = points.drop(value).withColumns(
        {value: F.lit(None).cast(observations.schema[value].dataType), "_side": F.lit(1)}
    )
    merged = asked.unionByName(observed, allowMissingColumns=True)
    out = scan(
        merged, keys, [*order, "_side"], {"_known": last_known(F.col(value))}, slice_col
    )
    return out.where(F.col("_side") == 1).withColumn(value, F.col("_known")).drop("_side", "_known")
