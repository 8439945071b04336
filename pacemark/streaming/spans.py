"""Run spans from two streams: starts and ends joined within a time interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRED, NO_END, NO_START = "paired", "no_end", "no_start"


def run_spans(
    starts: DataFrame, ends: DataFrame, keys: Sequence[str], within: str, delay: str
) -> DataFrame:
    """Each end with the start of its key that lies at most ``within`` before it.

    ``starts`` have the keys and ``start_ts``, ``ends`` the keys and ``end_ts``, and any further columns of other
    names. The result has both sides' columns, ``seconds`` and ``status``: ``paired``, ``no_end`` for a start or
    ``no_start`` for an end that nothing can match any more. Both sides carry a watermark, and the interval bounds
    what either side keeps: a start until ``within`` after it has passed, an end until the watermark passes it.
    Unmatched rows come out then. A key that very many rows share meets in one task; runs have keys of their own.
    """
    names = list(keys)
    a = starts.withColumnsRenamed({k: f"_a_{k}" for k in names}).withWatermark("start_ts", delay)
    b = ends.withColumnsRenamed({k: f"_b_{k}" for k in names}).withWatermark("end_ts", delay)
    near = (F.col("end_ts") >= F.col("start_ts")) & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"interval {within}"))
    for k in names:
        near = near & (F.col(f"_a_{k}") == F.col(f"_b_{k}"))
    status = (
        F.when(F.col("end_ts").isNull(), NO_END).when(F.col("start_ts").isNull(), NO_START).otherwise(PAIRED)
    )
    seconds = F.unix_seconds("end_ts") - F.unix_seconds("start_ts")
    both = [F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in names]
    rest = [c for c in [*starts.columns, *ends.columns] if c not in names]
    return a.join(b, near, "fullOuter").select(*both, *rest, seconds.alias("seconds"), status.alias("status"))
