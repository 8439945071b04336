"""Daemon logs: counts per file, token means, cleaning, record folding, severities, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.functions.text import contains_any, record_fields, token_from_end
from pacemark.operators.ordered import SLICE, last_known, row_number, running_sum, scan

# Texts looked for in logs, and texts whose lines are dropped.
CHECKPOINT_DONE = "Roll Edit Log"
PERIOD_CHANGED = "New checkpoint"
EDITS_LOADED = "INFO org.apache.hadoop.hdfs.server.namenode.FSImage: Edits file"
DROPPED = ["STARTUP_MSG:", "org.apache.hadoop.hdfs.StateChange:", "BlockStateChange: BLOCK*"]


def pattern_counts(
    lines: DataFrame,
    files: DataFrame,
    pattern: str,
    file: Sequence[str] = ("file",),
    text: str = "text",
) -> DataFrame:
    """Lines holding ``pattern`` per file; every file of ``files`` has a row, also with no line.

    The file list is added as rows that match nothing, so one aggregation does without a join.
    """
    found = lines.select(*file, F.col(text).contains(pattern).alias("_hit"))
    listed = files.select(*file, F.lit(False).alias("_hit"))
    return found.unionByName(listed).groupBy(*file).agg(F.count_if("_hit").alias("cnt"))


def with_empty_files(
    lines: DataFrame, files: DataFrame, file: Sequence[str] = ("file",)
) -> DataFrame:
    """All lines, and one row without a line for each file that has none."""
    empty = files.select(*file).join(lines.select(*file), list(file), "left_anti")
    return lines.unionByName(empty, allowMissingColumns=True)


def pattern_mean(counts: DataFrame) -> DataFrame:
    """Number of files and mean of their counts."""
    return counts.agg(F.count("*").alias("n_files"), F.avg("cnt").alias("mean_cnt"))


def cumulative_mean(counts: DataFrame, file_no: str = "file_no") -> DataFrame:
    """Mean per file where each log holds the lines of all earlier ones: last count over files."""
    return counts.agg(
        F.count("*").alias("n_files"),
        (F.max_by("cnt", file_no) / F.count("*")).alias("mean_cnt"),
    )


def token_mean(
    lines: DataFrame, marker: str = EDITS_LOADED, position: int = 5, text: str = "text"
) -> DataFrame:
    """Mean of a whole-number token, counted from the end, over the marked lines of all files."""
    marked = lines.where(F.col(text).contains(marker))
    return marked.select(
        token_from_end(F.col(text), position).try_cast("bigint").alias("_x")
    ).agg(F.count("_x").alias("n_lines"), F.avg("_x").alias("mean_token"))


def clean(lines: DataFrame, dropped: Sequence[str] = DROPPED, text: str = "text") -> DataFrame:
    """Lines that hold none of the texts, taken literally."""
    return lines.where(~contains_any(F.col(text), list(dropped)))


def number_records(
    lines: DataFrame,
    order: Sequence[str],
    file: Sequence[str] = ("file",),
    text: str = "text",
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Parse lines and add ``record_no``, the record of the file each line belongs to, and ``line_no``.

    A line that is no record continues the one before it. Lines before the first record have number 0.
    """
    parsed = lines.withColumns(record_fields(F.col(text)))
    starts = F.col("level").isNotNull().cast("bigint")
    counted = {"record_no": running_sum(starts), "line_no": row_number()}
    return scan(parsed, file, order, counted, slice_col)


def fold_records(numbered: DataFrame, file: Sequence[str] = ("file",)) -> DataFrame:
    """One row per record with its fields and ``n_more``, the number of continuation lines.

    Only counts are aggregated, so a record of any length costs one row per task. Its lines stay
    available under ``(file, record_no)``.
    """
    fields = ["ts", "myid", "level", "thread", "class", "src_line", "message"]
    is_head = F.col("level").isNotNull()
    return (
        numbered.groupBy(*file, "record_no")
        .agg(F.max(F.when(is_head, F.struct(*fields))).alias("_h"), F.count_if(~is_head).alias("n_more"))
        .select(*file, "record_no", *[F.col("_h")[f].alias(f) for f in fields], "n_more")
    )


def record_texts(
    numbered: DataFrame,
    file: Sequence[str] = ("file",),
    text: str = "text",
    separator: str = "\n",
    lines_per_piece: int = 1000,
) -> DataFrame:
    """Text of each record with its continuation lines, in pieces of at most ``lines_per_piece`` lines.

    Nearly all records are one ``piece``. A longer one has several, so none is ever gathered whole.
    """
    keys = [*file, "record_no"]
    begins = numbered.groupBy(*keys).agg(F.min("line_no").alias("_begin"))
    line = F.struct("line_no", F.col(text).alias("_x"))
    piece = F.floor((F.col("line_no") - F.col("_begin")) / lines_per_piece)
    return (
        numbered.join(begins, keys)
        .groupBy(*keys, piece.alias("piece"))
        .agg(F.sort_array(F.collect_list(line)).alias("_l"))
        .select(
            *keys, "piece", F.array_join(F.transform("_l", lambda x: x["_x"]), separator).alias("text")
        )
    )


def severity_rollup(
    records: DataFrame,
    level: str,
    ts: str = "ts",
    width: str = "1 day",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Records per level (and further keys) and time bucket."""
    return (
        records.groupBy(*keys, level, F.window(ts, width).alias("w"))
        .agg(F.count("*").alias("n"))
        .select(*keys, level, F.col("w.start").alias("bucket"), "n")
    )


def sessions(
    records: DataFrame, session: str, opened: str, closed: str, t: str = "t"
) -> DataFrame:
    """First opening, last closing and lifetime of each session (boolean columns tell the events)."""
    return (
        records.where(F.col(session).isNotNull())
        .groupBy(session)
        .agg(
            F.min(F.when(F.col(opened), F.col(t))).alias("opened_at"),
            F.max(F.when(F.col(closed), F.col(t))).alias("closed_at"),
        )
        .withColumn("lifetime", F.col("closed_at") - F.col("opened_at"))
    )


def session_events(records: DataFrame, message: str = "message") -> DataFrame:
    """Session id and what happened to it, from log messages."""
    text = F.col(message)
    return records.withColumns(
        {
            "session": F.nullif(F.regexp_extract(text, r"(0x[0-9a-f]+)", 1), F.lit("")),
            "opened": text.startswith("Established session"),
            "closed": text.startswith("Expiring session")
            | text.startswith("Closed socket connection"),
        }
    )


def carry_headers(
    lines: DataFrame,
    headers: dict[str, str],
    order: Sequence[str],
    file: Sequence[str] = ("file",),
    text: str = "text",
    slice_col: str | None = SLICE,
) -> DataFrame:
    """Add the latest match of each header pattern in the file (``name -> regex with one group``)."""
    return scan(
        lines,
        file,
        order,
        {
            name: last_known(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))
            for name, pattern in headers.items()
        },
        slice_col,
    )
