"""Sessions of activity: rows of a key that follow one another within a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.operators.ordered import SLICE


def _session(start: Column | str, gap: Column | str) -> Column:
    return F.session_window(start, gap).alias("_w")


def _spans(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Start, last row and number of rows of each session; ``_last`` is in the aggregates."""
    return df.select(*keys, F.col("_w.start").alias("start_ts"), "end_ts", "n")


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap: str, slice_col: str | None = SLICE) -> DataFrame:
    """``keys, start_ts, end_ts, n`` of each session, ``end_ts`` being the time of its last row.

    With a slice column, session windows are first merged inside each (key, slice), so that a busy key is divided.
    What is left per slice is one row per session, and those that touch over a slice's edge are merged by a
    second session window, whose gap is each session's own length. Rows without a time belong to no session.
    """
    rows = df.where(F.col(ts).isNotNull())
    own = [F.max(ts).alias("end_ts"), F.count("*").alias("n")]
    if slice_col is None:
        return _spans(rows.groupBy(*keys, _session(ts, gap)).agg(*own), keys)
    parts = rows.groupBy(*keys, slice_col, _session(ts, gap)).agg(*own)
    micros = F.unix_micros("_w.end") - F.unix_micros("_w.start")
    parts = parts.select(
        *keys,
        F.col("_w.start").alias("start_ts"),
        F.concat(micros.cast("string"), F.lit(" microseconds")).alias("length"),
        "end_ts",
        "n",
    )
    merged = parts.groupBy(*keys, _session("start_ts", F.col("length")))
    return _spans(merged.agg(F.max("end_ts").alias("end_ts"), F.sum("n").alias("n")), keys)


def session_stream(df: DataFrame, keys: Sequence[str], ts: str, gap: str, delay: str) -> DataFrame:
    """`sessions` of a stream: a session comes out once the watermark has passed its last row by the gap.

    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` merges a busy key's rows before the
    shuffle; set it when the stream starts.
    """
    rows = df.where(F.col(ts).isNotNull()).withWatermark(ts, delay)
    own = [F.max(ts).alias("end_ts"), F.count("*").alias("n")]
    return _spans(rows.groupBy(*keys, _session(ts, gap)).agg(*own), keys)
