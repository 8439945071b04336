"""Agent messages: parsing, roster, I/O totals, counters, alerts, rollups.

Messages have the columns of the key (``cluster``, ``client``), the order and ``msg``; parsed ones have
``verb`` and ``payload``. A client belongs to the cluster it reports to, so both are key columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.functions.stats import floor_div
from pacemark.operators.ordered import (
    SLICE,
    last_known,
    previous,
    running_max,
    running_sum,
    scan,
)

ORDER = ("us", "event_id")
CLUSTER = ("cluster",)
CLIENT = ("client", "cluster")  # the more selective key first: sorts compare it first

# Verbs of the protocol.
IN, OUT, UPDATE = "IN", "OUT", "UPDATE"
WITH_PAYLOAD = ["UPDATE", "UPDATE-RAM", "UPDATE-CC", "UPDATE-MTBF"]
TIMES = ["UPDATE-CC", "UPDATE-MTBF", "START", "STOP"]

OK, MESSAGE_ERROR, UNKNOWN = "ok", "message_error", "unknown"


def parse_messages(df: DataFrame, msg: str = "msg", lifecycle: bool = False) -> DataFrame:
    """Add ``verb``, ``payload`` and ``status``.

    ``IN`` and ``OUT`` match as a whole, the other verbs up to the first colon; the payload is the
    second colon field. A missing payload, or one of ``UPDATE`` that is no integer, is a message error;
    a cost or failure time that is no number too. RAM payloads may be anything (see `ram_percent`).
    With ``lifecycle``, ``START`` and ``STOP`` with a time are verbs as well.
    """
    known = [*WITH_PAYLOAD, *(["START", "STOP"] if lifecycle else [])]
    text = F.col(msg)
    head = F.substring_index(text, ":", 1)
    payload = F.try_element_at(F.split(text, ":"), F.lit(2))
    verb = (
        F.when(text.isin(IN, OUT), text)
        .when(head.isin(*known), head)
    )
    bad_number = (
        F.when(verb == UPDATE, F.trim(payload).try_cast("bigint").isNull())
        .when(verb.isin(*TIMES), F.trim(payload).try_cast("double").isNull())
        .otherwise(False)
    )
    status = (
        F.when(verb.isNull(), UNKNOWN)
        .when(verb.isin(*known) & (payload.isNull() | bad_number), MESSAGE_ERROR)
        .otherwise(OK)
    )
    return df.withColumns(
        {
            "verb": verb,
            "payload": F.when(verb.isin(*known), payload),
            "status": status,
        }
    )


def roster(
    df: DataFrame,
    keys: Sequence[str] = CLIENT,
    order: Sequence[str] = ORDER,
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Add ``live`` (registered after the row) and ``accepted``.

    ``IN`` registers, ``OUT`` removes. ``UPDATE`` and ``OUT`` of an unregistered client are rejected.
    """
    before = {"_before": last_known(_entry(), before=True)}
    return _with_roster(scan(df, keys, order, before, slice_col)).drop("_before", "_was_live")


def _entry() -> Column:
    """The verb where it registers or removes the client."""
    return F.when(F.col("verb").isin(IN, OUT), F.col("verb"))


def _with_roster(df: DataFrame) -> DataFrame:
    """Roster columns from ``_before``, the last such verb before the row."""
    verb = F.col("verb")
    live = F.coalesce(F.coalesce(_entry(), F.col("_before")) == IN, F.lit(False))
    was_live = F.coalesce(F.col("_before") == IN, F.lit(False))
    accepted = F.when(verb == IN, True).when(verb == OUT, was_live).otherwise(live)
    return df.withColumns({"live": live, "accepted": accepted, "_was_live": was_live})


def client_latest(
    df: DataFrame,
    value: str = "v",
    keys: Sequence[str] = CLIENT,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Latest value of each client that is still registered; one aggregation, no window."""
    verb, at = F.col("verb"), F.struct(*order)
    entry = F.max_by(verb, F.when(_entry().isNotNull(), at))
    # after the last IN every UPDATE counts, and IN itself sets zero
    last = F.max_by(F.when(verb == UPDATE, F.col(value)).otherwise(0), at)
    return (
        df.where(verb.isin(IN, OUT, UPDATE))
        .groupBy(*keys)
        .agg(entry.alias("_entry"), last.alias("latest"))
        .where(F.col("_entry") == IN)
        .drop("_entry")
    )


def io_total(
    df: DataFrame,
    value: str = "v",
    cluster: Sequence[str] = CLUSTER,
    client: Sequence[str] = CLIENT,
    order: Sequence[str] = ORDER,
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Add ``live``, ``accepted`` and ``total``: the sum of the latest values of all live clients.

    Each row changes the total by its client's new contribution minus the one before, so the total is a
    running sum of these changes. Two shuffles: by client and by cluster, both divided into slices.
    """
    verb = F.col("verb")
    own = F.struct(verb.alias("verb"), F.col(value).alias("v"))
    rows = scan(
        df.where(verb.isin(IN, OUT, UPDATE)),
        client,
        order,
        {"_before": last_known(_entry(), before=True), "_prior": previous(own)},
        slice_col,
    )
    adds = F.when((verb == UPDATE) & F.col("live"), F.col(value)).otherwise(0)
    added = F.when((F.col("_prior.verb") == UPDATE) & F.col("_was_live"), F.col("_prior.v"))
    changes = (
        _with_roster(rows)
        .withColumn("_delta", adds - F.coalesce(added, F.lit(0)))
        .drop("_before", "_prior", "_was_live")
    )
    return scan(changes, cluster, order, {"total": running_sum(F.col("_delta"))}, slice_col).drop(
        "_delta"
    )


def counter_rate(
    df: DataFrame,
    counter: str = "counter",
    seconds: str = "t",
    keys: Sequence[str] = CLIENT,
    order: Sequence[str] = ORDER,
    slice_col: str | None = SLICE,
    reset_is_null: bool = False,
) -> DataFrame:
    """Add ``rate``: counter difference per second between two readings, rounded down.

    NULL for the first reading and for readings in the same second; with ``reset_is_null`` also where
    the counter went back.
    """
    pair = F.struct(F.col(counter).alias("x"), F.col(seconds).alias("t"))
    out = scan(df, keys, order, {"_prior": previous(pair)}, slice_col)
    step = F.col(counter) - F.col("_prior.x")
    rate = floor_div(step, F.col(seconds) - F.col("_prior.t"))
    if reset_is_null:
        rate = F.when(step >= 0, rate)
    return out.withColumn("rate", rate).drop("_prior")


def rate_filter(df: DataFrame, min_rate: int = 0, rate: str = "rate") -> DataFrame:
    """Drop rates below ``min_rate``; readings without a rate (the first one) go too."""
    return df.where(F.col(rate) >= min_rate)


def ram_alerts(df: DataFrame, percent: str = "percent", threshold: float = 0.4) -> DataFrame:
    """Samples at or above ``threshold`` (0–1) of a percentage on the scale 0–100."""
    return df.where(F.col(percent) >= threshold * 100)


def ram_percent(payload: Column) -> Column:
    """Numeric value of an alert; anything else counts as 0.0 and is still an alert."""
    return F.coalesce(F.trim(payload).try_cast("double"), F.lit(0.0))


def latest_per_key(
    df: DataFrame, value: str, keys: Sequence[str] = CLUSTER, order: Sequence[str] = ORDER
) -> DataFrame:
    """Current value of each key: the one written last."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def skip_first_notice(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER
) -> DataFrame:
    """Every change except the first one of each key.

    The anti-join runs on the unique order columns, so that large keys spread over all tasks.
    """
    first = (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*order)).alias("_f"))
        .select(*keys, *[F.col(f"_f.{c}").alias(c) for c in order])
    )
    return df.join(first, [*keys, *order], "left_anti")


def windowed(
    df: DataFrame,
    value: str,
    ts: str = "ts",
    width: str = "10 minutes",
    slide: str | None = None,
    keys: Sequence[str] = CLUSTER,
) -> DataFrame:
    """Count, sum, mean and maximum per key and time window (batch or streaming)."""
    return (
        df.groupBy(*keys, F.window(ts, width, slide).alias("w"))
        .agg(
            F.count("*").alias("n"),
            F.sum(value).alias("sum_rate"),
            F.avg(value).alias("avg_rate"),
            F.max(value).alias("max_rate"),
        )
        .select(*keys, F.col("w.start").alias("window_start"), "n", "sum_rate", "avg_rate", "max_rate")
    )


def late_rows(
    df: DataFrame,
    time: str,
    arrival: Sequence[str],
    keys: Sequence[str] = CLUSTER,
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Rows that are older than one of their key that arrived before: these are late, the others current.

    The batch form of the rule for streams, with the order of arrival given by columns.
    """
    out = scan(df, keys, arrival, {"_seen": running_max(F.col(time), before=True)}, slice_col)
    late = F.coalesce(F.col(time) < F.col("_seen"), F.lit(False))
    return out.withColumn("late", late).drop("_seen")
