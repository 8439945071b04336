"""Telemetry source: agent messages as a table or a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns of a recorded message.
MESSAGE = "cluster string, client string, ts timestamp, us bigint, event_id bigint, msg string"


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Recorded messages as a table."""
    return spark.read.schema(MESSAGE).parquet(path)


def message_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None, schema: str = MESSAGE
) -> DataFrame:
    """Recorded messages as a stream; each new file in the folder is read once."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def kafka_messages(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Messages of a Kafka topic with one JSON object of the `MESSAGE` columns per record.

    Needs the Kafka connector on the class path.
    """
    from pyspark.sql import functions as F

    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), MESSAGE).alias("m")).select("m.*")
