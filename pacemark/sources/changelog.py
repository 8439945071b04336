"""A table of latest values that is written by changes: log, merge on read, compaction of touched buckets.

A batch appends its changes, one row per key, to a log folder of its own, laid out by bucket of the key's hash. The
state is the newest of base and log rows of each key, merged when it is read. A bucket whose log has grown to a
share of its base is compacted: it alone is merged and written to a new base generation. So what is written
follows the changes: a change is written once to the log and, over time, ``1 + 1 / ratio`` times to bases.

A small manifest says, per bucket, which generation is its base, how many rows it has and up to which log number
it holds the log. The manifest is written last (`write_version`), so a compaction that fails leaves the table as it
was. Log folders are numbered over all streams and named by stream and batch: a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacemark.operators.telemetry import ORDER
from pacemark.sources.sinks import Version, _files, _versions, read_version, stream_of, write_version

ROW = "path string, value string, number bigint, bucket int"
MANIFEST = "bucket int, generation bigint, upto bigint, n_rows bigint"


@dataclass(frozen=True)
class ChangeLog:
    """One table; ``buckets`` is fixed when it is first written. ``ratio`` is log rows to base rows at compaction."""

    folder: str
    buckets: int = 64
    ratio: float = 0.5
    order: Sequence[str] = ORDER

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def write(self, df: DataFrame, batch: int, stream: str | None = None) -> int:
        """Append the last value per ``path`` of a batch, ordered by ``order``; returns the log's number.

        The one value per key is found by an aggregation that combines before its shuffle, so a key may make up
        most of a batch. A null path is a key like any other.
        """
        stream = stream or stream_of(df)
        logs = self._logs(df.sparkSession)
        newest = max((v.batch for v in logs if v.stream == stream), default=batch)
        if batch < newest:
            raise ValueError(f"{self.folder} has batch {newest} of stream {stream}; batch {batch} is older")
        again = [v for v in logs if (v.stream, v.batch) == (stream, batch)]
        own = again[0] if again else Version(max([v.number for v in logs], default=-1) + 1, stream, batch)
        last = df.groupBy("path").agg(F.max_by("value", F.struct(*self.order)).alias("value"))
        rows = last.select("path", "value", F.lit(own.number).cast("bigint").alias("number"), self.bucket().alias("bucket"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.folder}/log/{own.folder}"
        )
        return own.number

    def read(self, spark: SparkSession) -> DataFrame:
        """The state: ``path, value, number`` of each key, ``number`` being that of the log that set it."""
        known = self._manifest(spark)
        return self._merged(spark, known, self._log_rows(spark, self._logs(spark), known)).drop("bucket")

    def compact(self, spark: SparkSession, ratio: float | None = None) -> list[int]:
        """Merge the buckets whose log has at least ``ratio`` times the rows of their base; returns them."""
        logs, manifest = self._logs(spark), self._manifest(spark)
        fresh = self._log_rows(spark, logs, manifest)
        sizes = fresh.groupBy("bucket").count().collect()  # one row per bucket
        limit, base = self.ratio if ratio is None else ratio, {r.bucket: r.n_rows for r in manifest}
        grown = sorted(r["bucket"] for r in sizes if r["count"] >= limit * base.get(r["bucket"], 0))
        if not grown:
            return []
        generation = max([r.generation for r in manifest], default=-1) + 1
        folder = f"{self.folder}/base/generation={generation}"
        merged = self._merged(
            spark, [r for r in manifest if r.bucket in grown], fresh.where(F.col("bucket").isin(grown))
        )
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = spark.read.schema(ROW).parquet(folder).groupBy("bucket").count().collect()
        upto = max(v.number for v in logs)
        rows = [tuple(r) for r in manifest if r.bucket not in grown]
        rows += [(r["bucket"], generation, upto, r["count"]) for r in written]
        write_version(
            spark.createDataFrame(rows, MANIFEST).coalesce(1), f"{self.folder}/manifest", generation, "compaction"
        )
        return grown

    def vacuum(self, spark: SparkSession) -> None:
        """Delete logs that all buckets hold in their base, and generations that no bucket has as base.

        The newest log stays; numbers go on from it.
        """
        logs, manifest = self._logs(spark), self._manifest(spark)
        if not manifest:
            return
        waiting = self._log_rows(spark, logs, manifest).agg(F.min("number")).first()[0]
        held = logs[-1].number if waiting is None else waiting
        at, fs, _ = _files(spark, self.folder)
        for v in [v for v in logs if v.number < held]:
            fs.delete(at(f"{self.folder}/log/{v.folder}"), True)
        used = {f"generation={r.generation}" for r in manifest}
        for status in fs.listStatus(at(f"{self.folder}/base")):
            if status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)

    def batches(self) -> Callable[[DataFrame, int], None]:
        """``foreachBatch`` function: append, then compact what has grown."""

        def work(df: DataFrame, batch: int) -> None:
            self.write(df, batch)
            self.compact(df.sparkSession)

        return work

    def _logs(self, spark: SparkSession) -> list[Version]:
        return _versions(spark, f"{self.folder}/log")

    def _manifest(self, spark: SparkSession) -> list:
        return read_version(spark, f"{self.folder}/manifest", MANIFEST).collect()  # one row per bucket

    def _log_rows(self, spark: SparkSession, logs: list[Version], manifest: list) -> DataFrame:
        """Rows of the log that their bucket's base does not hold."""
        held = min((r.upto for r in manifest), default=-1) if len(manifest) == self.buckets else -1
        paths = [f"{self.folder}/log/{v.folder}" for v in logs if v.number > held]
        if not paths:
            return spark.createDataFrame([], ROW)
        rows = spark.read.schema(ROW).option("basePath", f"{self.folder}/log").parquet(*paths)
        if manifest:
            upto = F.create_map(*[F.lit(x) for r in manifest for x in (r.bucket, r.upto)])
            rows = rows.where(F.col("number") > F.coalesce(upto[F.col("bucket")], F.lit(-1)))
        return rows.select("path", "value", "number", "bucket")

    def _merged(self, spark: SparkSession, manifest: list, rows: DataFrame) -> DataFrame:
        """Newest of the given log rows and of the bases that the manifest names."""
        if manifest:
            paths = [f"{self.folder}/base/generation={r.generation}/bucket={r.bucket}" for r in manifest]
            base = spark.read.schema(ROW).option("basePath", f"{self.folder}/base").parquet(*paths)
            rows = rows.unionByName(base.select("path", "value", "number", "bucket"))
        newest = F.max_by(F.struct("value", "number"), F.col("number"))
        return rows.groupBy("bucket", "path").agg(newest.alias("s")).select("path", "s.value", "s.number", "bucket")
