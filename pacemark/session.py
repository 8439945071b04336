"""Session settings and lineage cuts shared by the operators."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def runs_in_tasks(module: str) -> None:
    """Send the functions of a module to the tasks themselves, not as an import.

    Executors then need no copy of this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


runs_in_tasks(__name__)  # modules that are sent to tasks refer to functions of this one


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pacemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only on a single machine without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pacemark-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` in the checkpoint folder and continue from the stored copy.

    Used where two branches read an expensive intermediate result, so that it is computed once and
    survives the loss of executors.
    """
    sc = df.sparkSession.sparkContext
    folder = checkpoint_dir(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Session settings for a while; double underscores in the names stand for dots."""
    names = {"spark.sql." + k.replace("__", "."): str(v) for k, v in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def cut_in_layout(df: DataFrame, keys: list[str]) -> DataFrame:
    """`cut`, hash-partitioned and sorted by ``keys`` in a way that later joins and groupings know.

    A checkpoint keeps its partitioning only if it was written without adaptive planning; so that is
    switched off for this one write.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, adaptive__enabled="false"):
        return cut(df.repartition(n, *keys).sortWithinPartitions(*keys))
