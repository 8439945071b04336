"""Running a stream over what is there, into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pacemark.session import checkpoint_dir


def stream_folder(spark: SparkSession) -> str:
    """A new folder for a stream's output and checkpoint, below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/pacemark-streams/{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A table folder or file as a stream; it has the columns that the table has now.

    The file source takes folders and patterns only, so the path becomes a pattern of its own name.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Work off all data that is there, then read the appended rows.

    ``folder`` holds ``out`` and ``checkpoint``; with the folder of an earlier run the stream goes on there.
    """
    spark = stream.sparkSession
    folder = folder or stream_folder(spark)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(f"{folder}/out")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
