"""Fields of result lines and log lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of the lines and labels.
RECORD = (
    r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) \[myid:(\d*)\] - (\w+)\s+"
    r"\[(.*?)(?::([A-Za-z]\w*)@(\d+))?\] - (.*)$"
)
SEPARATOR = "\u0001"
RUN_LABEL = r"(TeraGen|TeraSort|TestDFSIOe|TestDFSIO|Spark HiBench)"
RUN_PHASE = r"[(\[](AF|DF)[)\]]"
RUN_CHECKPOINT = r"TestDFSIO-(\d+)"
RUN_REP = r"(?:#|>> Run )(\d+)"
RUN_SECONDS = r"(?:=|>>) *(\d+(?:\.\d+)?) (?:seg|sec|s)\.\s*$"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def seconds_after_equals(line: Column) -> Column:
    """Second space-separated token after the last ``=``, as an integer; NULL if malformed."""
    tail = F.element_at(F.split(line, "="), -1)
    token = F.try_element_at(F.split(tail, " "), F.lit(2))
    return token.try_cast("int")


def last_token(line: Column) -> Column:
    """Text after the last space."""
    return F.substring_index(line, " ", -1)


def last_token_double(line: Column) -> Column:
    """Last space-separated token as a number; NULL if it is none."""
    return last_token(line).try_cast("double")


def token_from_end(line: Column, position: int) -> Column:
    """The ``position``-th space-separated token counted from the end."""
    return F.try_element_at(F.split(line, " "), F.lit(-position))


def run_fields(line: Column) -> dict[str, Column]:
    """Label, phase, checkpoint period, repetition and seconds of a run-time line."""
    return {
        "benchmark": _found(line, RUN_LABEL),
        "phase": _found(line, RUN_PHASE),
        "checkpoint_s": _found(line, RUN_CHECKPOINT).try_cast("int"),
        "rep": _found(line, RUN_REP).try_cast("int"),
        "seconds": _found(line, RUN_SECONDS).try_cast("double"),
    }


def record_fields(line: Column) -> dict[str, Column]:
    """Fields of a log record; all NULL for a continuation line.

    One replacement puts a mark between the groups, so the line is not matched anew for every field.
    """
    groups = SEPARATOR.join(f"${i}" for i in range(1, 8))
    parts = F.when(
        line.rlike(RECORD), F.split(F.regexp_replace(line, RECORD, groups), SEPARATOR, 7)
    )

    def given(i: int) -> Column:
        return F.nullif(parts[i], F.lit(""))

    return {
        "ts": F.try_to_timestamp(parts[0], F.lit("yyyy-MM-dd HH:mm:ss,SSS")),
        "myid": parts[1],
        "level": parts[2],
        "thread": parts[3],
        "class": given(4),
        "src_line": given(5).try_cast("int"),
        "message": parts[6],
    }


def contains_any(line: Column, texts: list[str]) -> Column:
    """True where the line holds one of the texts, taken literally."""
    found = F.lit(False)
    for text in texts:
        found = found | line.contains(text)
    return found
