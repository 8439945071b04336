"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where a session names none and runs inside one process (``local[...]``), as tests do, a
    temporary folder is made and named in the session. Anything else without the setting is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="pacemark-llm-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and go on from the written copy.

    Cuts lineage: a result that several branches read is computed once, and a lost executor costs
    nothing that was written. The files are columnar and compressed; they stay until the folder is
    cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/pacemark-llm/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links between BIGINT nodes: ``node, root`` (smallest node).

    Alternates the large-star and small-star steps: every node hands its neighbours to its smallest
    one, first the larger neighbours, then the smaller ones and itself. The number of rounds grows
    with the logarithm of the longest path. Minima are combined before the shuffle and written; the join that
    hands them out reads them anew with one row per node, so a node with very many links can be split.
    Each round is written to the shared folder. Nodes without links do not occur in the result.
    """
    edges = store(
        links.select(
            F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")
        )
        .where("u <> v")
        .distinct()
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = store(low.select("u", F.least("u", "m").alias("m")))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = store(large)
        least = store(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = store(small)
        total = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if total == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = total


def numbered(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """Dense numbers from 0 along ``order``, over all rows, without gathering them in one task.

    Rows are dealt by range, sorted and written; their places inside a part and the parts' sizes give the
    number. One row per part, as many as the session has shuffle partitions, is sent to all tasks.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = store(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begin = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_begin"))
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(begin), "_part")
        .withColumn(name, F.col("_begin") + place)
        .drop("_part", "_begin", "_at")
    )
