"""Sinks: append, latest value per key, and their streaming forms.

A micro-batch is known by its stream and its number. The stream's id comes from its checkpoint, so it stays
over restarts, and a stream with a new checkpoint, which counts from 0 again, is another one. A repeated
batch replaces itself; nothing replaces the batches of another stream. A batch that is older than the
newest one of its stream is refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacemark.operators.kvtree import upsert
from pacemark.operators.telemetry import ORDER

SHAPE = "path string, value string"


def append(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Add rows to a table folder."""
    df.write.mode("append").format(form).save(path)


def stream_of(df: DataFrame) -> str:
    """Id of the stream whose batch is being worked off; ``direct`` outside of a stream."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


def write_batch(df: DataFrame, path: str, batch: int, stream: str | None = None) -> None:
    """The rows of one batch, in a folder of their own."""
    df.write.mode("overwrite").parquet(f"{path}/stream={stream or stream_of(df)}/batch={batch}")


def without_repeats(df: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    """A stream's rows without those that repeat the keys of one that came at most ``delay`` of event time before.

    What is kept to know repeats by is the keys of the last ``delay``. Repeats in the same batch are dropped too.
    """
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def append_batches(path: str):
    """``foreachBatch`` function that appends exactly once per batch."""

    def write(df: DataFrame, batch: int) -> None:
        write_batch(df, path, batch)

    return write


@dataclass(frozen=True)
class Version:
    """A state table as a batch left it; ``number`` counts over all streams."""

    number: int
    stream: str
    batch: int

    @property
    def folder(self) -> str:
        return f"version={self.number}_{self.stream}_{self.batch}"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return jvm.org.apache.hadoop.fs.Path, fs, folder


def _versions(spark: SparkSession, path: str) -> list[Version]:
    """Complete versions, oldest first; only folder names are listed."""
    at, fs, folder = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = []
    for name in names:
        if name.startswith("version=") and fs.exists(at(f"{path}/{name}/_SUCCESS")):
            number, stream, batch = name.removeprefix("version=").split("_")
            done.append(Version(int(number), stream, int(batch)))
    return sorted(done, key=lambda v: v.number)


def read_version(
    spark: SparkSession, path: str, schema: str, stream: str | None = None, batch: int | None = None
) -> DataFrame:
    """Newest state table, or what the given batch begins with; empty if there is none."""
    versions = [v for v in _versions(spark, path) if (v.stream, v.batch) != (stream, batch)]
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{versions[-1].folder}")


def write_version(
    df: DataFrame, path: str, batch: int, stream: str | None = None, keep: int = 3
) -> None:
    """State table after ``batch``; all but the newest ``keep`` versions are deleted."""
    spark, stream = df.sparkSession, stream or stream_of(df)
    versions = _versions(spark, path)
    newest = max((v.batch for v in versions if v.stream == stream), default=batch)
    if batch < newest:
        raise ValueError(f"{path} has batch {newest} of stream {stream}; batch {batch} is older")
    again = [v for v in versions if (v.stream, v.batch) == (stream, batch)]
    own = again[0] if again else Version(versions[-1].number + 1 if versions else 0, stream, batch)
    df.write.mode("overwrite").parquet(f"{path}/{own.folder}")
    at, fs, _ = _files(spark, path)
    for old in [v for v in versions if v.number < own.number][: -(keep - 1)]:
        fs.delete(at(f"{path}/{old.folder}"), True)


def upsert_batches(path: str, order: Sequence[str] = ORDER):
    """``foreachBatch`` function that keeps the last value per ``path`` in a versioned table."""

    def write(df: DataFrame, batch: int) -> None:
        current = read_version(df.sparkSession, path, SHAPE, stream_of(df), batch)
        last = df.groupBy("path").agg(F.max_by("value", F.struct(*order)).alias("value"))
        write_version(upsert(current, last).select("path", "value"), path, batch)

    return write
