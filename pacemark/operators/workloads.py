"""Workloads under test: word count, PageRank, total sort, Monte-Carlo Pi, transfer probes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pacemark.operators.ordered import SLICE, row_number, scan
from pacemark.session import cut, cut_in_layout, runs_in_tasks, settings


runs_in_tasks(__name__)

SORTED_ROWS = 500_000  # of a range partition


def wordcount(df: DataFrame, text: str = "text", separator: str = r"[ \t\r\n]+") -> DataFrame:
    """Occurrences of each word; counted per task before the shuffle."""
    words = df.select(F.explode(F.split(text, separator)).alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("cnt"))


def inside_circle(x: Column, y: Column) -> Column:
    """1 for points of the unit circle, both coordinates from 0 to 1 stretched to -1 to 1."""
    a, b = 2 * x - 1, 2 * y - 1
    return F.when(a * a + b * b <= 1, 1).otherwise(0)


def pi_estimate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pi from the union of two point sets (``x``, ``y``); ``sevens`` weighs hits of the second by 7."""
    points = first.select("x", "y", F.lit(0).alias("w")).unionByName(
        second.select("x", "y", F.lit(7).alias("w"))
    )
    hit = inside_circle(F.col("x"), F.col("y"))
    return points.agg(
        F.count("*").alias("n"),
        F.sum(hit).alias("hits"),
        F.sum(hit * F.col("w")).alias("sevens"),
        (4.0 * F.sum(hit) / F.count("*")).alias("pi"),
    )


def pi_random(spark: SparkSession, partitions: int, seed: int = 1) -> DataFrame:
    """`pi_estimate` over 100,000 random points per partition, twice."""
    n = 100_000 * partitions  # fixed value: points per partition

    def points(s: int) -> DataFrame:
        return spark.range(n, numPartitions=partitions).select(
            F.rand(s).alias("x"), F.rand(s + 1).alias("y")
        )

    return pi_estimate(points(seed), points(seed + 2))


def total_sort(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows in total order: range partitions, each sorted.

    Without a number of ``partitions``, a partition has about `SORTED_ROWS` rows at most, whatever the size of the
    table, so that the memory of a task does not grow with it.
    """
    if partitions is None and (rows := df.count()) > SORTED_ROWS:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(least, -(-rows // SORTED_ROWS))
    ranged = (
        df.repartitionByRange(*order)
        if partitions is None
        else df.repartitionByRange(partitions, *order)
    )
    return ranged.sortWithinPartitions(*order)


def sort_check(sorted_df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows, partitions and overlapping neighbours of a sorted table (0 if the order is total)."""
    key = F.struct(*order)
    spans = (
        sorted_df.select(F.spark_partition_id().alias("p"), key.alias("k"))
        .groupBy("p")
        .agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    )
    before = F.lag("hi").over(Window.orderBy("p"))  # one row per partition
    return spans.select("n", (before > F.col("lo")).alias("late")).agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_partitions"),
        F.count_if("late").alias("overlaps"),
    )


def sort_positions(
    df: DataFrame, order: Sequence[str], slice_col: str = SLICE, name: str = "pos"
) -> DataFrame:
    """Position of each row in the total order, from 1."""
    return scan(df, [], order, {name: row_number()}, slice_col)


@dataclass
class Cadence:
    """How many iterations to run between two checkpoints.

    A run of ``k`` iterations with its checkpoint takes about ``k * iteration + cost`` seconds. From
    the runs measured so far both are estimated, and Young's period for the given mean time between
    failures divided by the iteration time is the next ``k``.
    """

    mtbf_s: float
    longest: int = 10
    runs: list[tuple[int, float]] = field(default_factory=list)

    def observe(self, iterations: int, seconds: float) -> None:
        self.runs.append((iterations, seconds))

    def estimate(self) -> tuple[float, float]:
        """Seconds per iteration and per checkpoint, by least squares over the runs."""
        n = len(self.runs)
        mean_k = sum(k for k, _ in self.runs) / n
        mean_s = sum(s for _, s in self.runs) / n
        spread = sum((k - mean_k) ** 2 for k, _ in self.runs)
        if spread == 0:
            return mean_s / mean_k, 0.0
        slope = sum((k - mean_k) * (s - mean_s) for k, s in self.runs) / spread
        each = min(max(slope, 1e-3), mean_s / mean_k)
        return each, max(mean_s - each * mean_k, 0.0)

    def next(self) -> int:
        if len(self.runs) < 2:
            return len(self.runs) + 1  # one iteration, then two: enough for a first estimate
        each, cost = self.estimate()
        period = (2 * cost * self.mtbf_s) ** 0.5
        return max(1, min(self.longest, int(period // each)))


def iterate(
    state: DataFrame,
    step: Callable[[DataFrame, int], DataFrame],
    iterations: int,
    cadence: Cadence,
    alert: Callable[[], bool] = lambda: False,
    store: Callable[[DataFrame], DataFrame] = cut,
) -> DataFrame:
    """Apply ``step(state, i)`` repeatedly, checkpointing with ``store`` as the cadence says and at the end.

    ``alert`` is asked after each iteration and forces a checkpoint, e.g. on low memory.
    """
    since, planned, began = 0, cadence.next(), time.monotonic()
    for i in range(iterations):
        state = step(state, i)
        since += 1
        if since >= planned or i == iterations - 1 or alert():
            state = store(state)
            cadence.observe(since, time.monotonic() - began)
            since, planned, began = 0, cadence.next(), time.monotonic()
    return state


BROADCAST_ROWS = 1_000_000
EDGES_PER_PARTITION = 200_000


def pagerank(
    edges: DataFrame,
    iterations: int,
    damping: float = 0.85,
    cadence: Cadence | None = None,
    edges_per_part: int = 1_000_000,
) -> DataFrame:
    """PageRank over distinct edges (``src``, ``dst``) for a fixed number of iterations.

    Nodes without outgoing edges spread their rank evenly. Edges and nodes are laid out once, by source
    and by node, so an iteration shuffles nothing but partial sums. If a source has more than
    ``edges_per_part`` edges, edges are divided further and ranks are copied to the parts.
    """
    spark = edges.sparkSession
    given = cut(edges.select("src", "dst"))
    n_edges = given.count()
    if not n_edges:
        return given.select(F.col("src").alias("node"), F.lit(0.0).alias("rank")).where(F.lit(False))
    spread = 1 + n_edges // EDGES_PER_PARTITION
    pace = cadence or Cadence(mtbf_s=3600.0)
    with settings(spark, shuffle__partitions=spread):
        return _ranks(given, iterations, damping, pace, edges_per_part)


def _ranks(
    given: DataFrame, iterations: int, damping: float, pace: Cadence, edges_per_part: int
) -> DataFrame:
    degrees = given.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    targets = given.select(F.col("dst").alias("node")).distinct()
    nodes = cut_in_layout(cut(degrees.join(targets, "node", "full")), ["node"])
    n = nodes.count()
    dangling = not nodes.where(F.col("deg").isNull()).isEmpty()

    parts = F.ceil(F.col("deg") / edges_per_part)
    large = nodes.where(F.col("deg") > edges_per_part).select(
        F.col("node").alias("src"), parts.alias("_parts")
    )
    n_large = large.count()
    keys = ["src"]
    if n_large:
        keys = ["src", "part"]
        few = n_large <= BROADCAST_ROWS
        # beyond that, a join that adaptive planning splits at the large sources
        found = given.join(F.broadcast(large) if few else large, "src", "left")
        part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("_parts")), F.lit(0).cast("bigint"))
        given = cut(found.select("src", "dst", part.alias("part")))
    laid = cut_in_layout(given, keys)

    def step(ranks: DataFrame, _: int) -> DataFrame:
        giving = ranks.where(F.col("deg").isNotNull()).select(
            F.col("node").alias("src"), "deg", (F.col("rank") / F.col("deg")).alias("share")
        )
        if n_large:
            copies = F.sequence(F.lit(0).cast("bigint"), parts - 1)
            giving = giving.withColumn("part", F.explode(copies))
        received = (
            laid.join(giving.drop("deg"), keys)
            .groupBy(F.col("dst").alias("node"))
            .agg(F.sum("share").alias("got"))
        )
        lost = F.lit(0.0)
        if dangling:
            lost = ranks.where(F.col("deg").isNull()).agg(F.sum("rank")).scalar()
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)
        return nodes.join(received, "node", "left").select("node", "deg", rank.alias("rank"))

    start = nodes.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0))
    ranks = iterate(
        start, step, iterations, pace, store=lambda df: cut_in_layout(df, ["node"])
    )
    return ranks.select("node", "rank")


def write_probe(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and report files, megabytes, seconds and throughput."""
    began = time.monotonic()
    df.write.mode("overwrite").parquet(path)
    seconds = time.monotonic() - began
    files = df.sparkSession.read.format("binaryFile").load(path).select("length")
    return files.agg(
        F.count("*").alias("n_files"),
        (F.sum("length") / F.lit(1e6)).alias("total_mb"),
        F.max(F.lit(seconds)).alias("exec_s"),
        (F.sum("length") / F.lit(1e6) / F.lit(seconds)).alias("throughput"),
    )


def observed_write(df: DataFrame, path: str, parts: str, line: str = "line") -> DataFrame:
    """Write the text lines of ``df`` in a folder per value of ``parts`` and report them per folder.

    ``n_rows`` and ``n_bytes`` (line ends included) are counted by the write itself (`Observation`, one pass over
    what is written); ``part_rows``, ``n_files`` and ``part_bytes`` come from the written files and their metadata.
    """
    seen = Observation()
    size = (F.octet_length(line) + 1).cast("bigint")
    watched = df.select(parts, line).observe(seen, F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))
    watched.repartition(parts).write.mode("overwrite").partitionBy(parts).text(path)
    told = seen.get
    back = df.sparkSession.read.text(path).select(
        F.col(parts), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length")
    )
    files = back.groupBy(parts, "file").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    return files.groupBy(parts).agg(
        F.sum("n").alias("part_rows"),
        F.count("*").alias("n_files"),
        F.sum("length").alias("part_bytes"),
        F.max(F.lit(told["n_rows"]).cast("bigint")).alias("n_rows"),
        F.max(F.lit(told["n_bytes"]).cast("bigint")).alias("n_bytes"),
    )


def read_probe(df: DataFrame) -> DataFrame:
    """Read ``df`` to the end; rows, megabytes in memory and seconds per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began, rows, size = time.monotonic(), 0, 0
        for pdf in batches:
            rows += len(pdf)
            size += int(pdf.memory_usage(index=False).sum())
        yield pd.DataFrame(
            {
                "task": [TaskContext.get().partitionId()],
                "n_rows": [rows],
                "mb": [size / 1e6],
                "seconds": [time.monotonic() - began],
            }
        )

    return df.mapInPandas(run, "task int, n_rows bigint, mb double, seconds double")
