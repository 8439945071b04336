"""Supervision of message streams: roster, I/O totals, histories and announced periods.

Every micro-batch is worked off with the batch operators, so a busy cluster is divided into slices
like in a table. What earlier batches left behind is a few small state tables, which enter as rows
ordered before the batch:

* ``clients``: registered clients and their latest rate,
* ``rings``: the last N observations of each series,
* ``clusters``: announced period, last failure time and last processed position.

State and output are written under the stream and the number of the batch, and a batch reads the newest
state that is not its own. A batch that is repeated after a failure replaces what it wrote the first time;
a stream with a new checkpoint goes on from the state of the one before.

With ``carry``, START and STOP messages count: the time between failures is taken from the START or the
failure before, plus the running time that a STOP stored. The state then holds the anchor, the stored time
and whether the supervisor runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pacemark.functions.periods import (
    HISTORY_LENGTH,
    PERIOD_START,
    PERIOD_THRESHOLD,
    YOUNG,
)
from pacemark.operators import history, policy, telemetry
from pacemark.operators.ordered import SLICE, Slices
from pacemark.session import cut
from pacemark.sources.sinks import read_version, stream_of, write_batch, write_version

ORDER = list(telemetry.ORDER)
SERIES = list(history.SERIES)
CLIENTS = "cluster string, client string, latest bigint"
RINGS = "cluster string, series string, slot int, value bigint, pointer int"
CLUSTERS = (
    "cluster string, period bigint, failed_at bigint, last_us bigint, last_event_id bigint, "
    "ram double, elapsed bigint, running boolean"
)


@dataclass(frozen=True)
class Supervisor:
    """Settings of one supervision; ``folder`` holds its state and output tables."""

    folder: str
    policy: int = YOUNG
    start: int = PERIOD_START
    threshold: int = PERIOD_THRESHOLD
    history: int = HISTORY_LENGTH
    dynamic: bool = True
    compat: bool = False
    carry: bool = False
    rows_per_slice: int = 2_000_000

    def table(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def state(self, spark: SparkSession, name: str, schema: str, stream: str, batch: int) -> DataFrame:
        return read_version(spark, self.table(name), schema, stream, batch)

    def seed(self, clients: DataFrame, rings: DataFrame, clusters: DataFrame) -> None:
        """Begin from given state tables (a restored snapshot) instead of from nothing."""
        for name, df in (("clients", clients), ("rings", rings), ("clusters", clusters)):
            write_version(df, self.table(name), -1, "seed")

    def process(self, messages: DataFrame, batch: int) -> None:
        """Work off one batch of messages (columns of the telemetry source)."""
        spark = messages.sparkSession
        stream = stream_of(messages)
        clients = self.state(spark, "clients", CLIENTS, stream, batch)
        rings = self.state(spark, "rings", RINGS, stream, batch)
        clusters = self.state(spark, "clusters", CLUSTERS, stream, batch)

        position = F.struct(F.col("us"), F.col("event_id"))
        done = F.struct(F.col("last_us").alias("us"), F.col("last_event_id").alias("event_id"))
        parsed = telemetry.parse_messages(messages, lifecycle=self.carry)
        known = cut(
            parsed.join(clusters.select("cluster", "last_us", "last_event_id"), "cluster", "left")
            .withColumn("late", F.coalesce(position <= done, F.lit(False)))
            .drop("last_us", "last_event_id")
        )
        self._write(known.where("late").drop("late"), "late", batch)
        on_time = known.where(~F.col("late")).drop("late")
        self._write(on_time.where(F.col("status") != telemetry.OK), "rejected", batch)
        rows = Slices.plan(on_time, ORDER, self.rows_per_slice).assign(on_time)
        rows = rows.where(F.col("status") == telemetry.OK)

        agents = self._agent_rows(rows, clients)
        live = telemetry.client_latest(agents)
        totals = cut(telemetry.io_total(agents).where(F.col("us") >= 0))
        self._write(
            totals.where(~F.col("accepted")).select("cluster", "client", *ORDER, "verb"),
            "unregistered",
            batch,
        )
        accepted = totals.where(F.col("accepted"))
        self._write(accepted.select("cluster", *ORDER, "verb", "total"), "totals", batch)
        io = policy.io_period(accepted.where(F.col("verb") == telemetry.UPDATE))

        observed = cut(self._observations(rows, rings, clusters))
        means = policy.averages(observed.drop("restored"), self.history).where(F.col("us") >= 0)
        computed = policy.candidates(means, self.policy, self.compat)

        given = clusters.select("cluster", F.col("period").alias("_given"))

        def with_start(df: DataFrame) -> DataFrame:
            joined = df.join(given, "cluster", "left")
            return joined.withColumn("_begin", F.coalesce("_given", F.lit(self.start)))

        announced = cut(
            policy.controller(
                with_start(io),
                with_start(computed),
                "_begin",
                self.threshold,
                self.dynamic,
            )
        )
        self._write(announced.select("cluster", *ORDER, "kind", "period"), "announced", batch)

        alerts = rows.where(F.col("verb") == "UPDATE-RAM").select(
            "cluster", "client", *ORDER, telemetry.ram_percent(F.col("payload")).alias("ram")
        )
        self._write(alerts, "ram_alerts", batch)

        self._save("clients", live, batch)
        newest = history.ring_current(observed, self.history, SERIES, ORDER)
        pointers = newest.groupBy(*SERIES).agg(
            F.max_by("slot", F.struct(*ORDER)).alias("pointer")
        )
        self._save(
            "rings",
            newest.join(pointers, SERIES).select(
                "cluster", "series", "slot", "value", "pointer"
            ),
            batch,
        )
        after = self._clusters(clusters, on_time, rows, announced, alerts)
        self._save("clusters", after, batch)

    def run(self, messages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Start supervising a message stream, by default with all data that is there."""
        return (
            messages.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """An output table over all batches: announced, totals, rejected, unregistered, late, ram_alerts."""
        return spark.read.parquet(self.table(name))

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        write_batch(df, self.table(name), batch)

    def _save(self, name: str, df: DataFrame, batch: int) -> None:
        write_version(df, self.table(name), batch)

    @staticmethod
    def _agent_rows(rows: DataFrame, clients: DataFrame) -> DataFrame:
        """Roster messages of the batch after an IN and an UPDATE for each registered client."""
        plain = rows.where(F.col("verb").isin("IN", "OUT", "UPDATE")).select(
            "cluster",
            "client",
            *ORDER,
            SLICE,
            "verb",
            F.when(F.col("verb") == "UPDATE", F.trim("payload").cast("bigint")).alias("v"),
        )
        seeds = clients.select(
            "cluster",
            "client",
            F.inline(
                F.array(
                    F.struct(F.lit(-2).alias("us"), F.lit("IN").alias("verb"), F.lit(0).alias("v")),
                    F.struct(F.lit(-1).alias("us"), F.lit("UPDATE").alias("verb"), F.col("latest").alias("v")),
                )
            ),
        ).select(
            "cluster",
            "client",
            F.col("us").cast("bigint").alias("us"),
            F.xxhash64("client").alias("event_id"),
            F.lit(-1).cast("bigint").alias(SLICE),
            "verb",
            F.col("v").cast("bigint").alias("v"),
        )
        return plain.unionByName(seeds)

    def _observations(self, rows: DataFrame, rings: DataFrame, clusters: DataFrame) -> DataFrame:
        """Observations of the batch after those stored in the rings, numbered together."""
        verb, payload = F.col("verb"), F.trim("payload")
        is_cost = verb == "UPDATE-CC"
        fresh = rows.where(verb.isin("UPDATE-CC", "UPDATE-MTBF")).select(
            "cluster",
            F.when(is_cost, policy.COST).otherwise(policy.MTBF).alias("series"),
            *ORDER,
            SLICE,
            F.when(~is_cost, history.whole(payload)).alias("t"),
            F.when(is_cost, history.whole(payload)).alias("value"),
        )
        before = clusters.where(F.col("failed_at").isNotNull()).select(
            "cluster",
            F.lit(policy.MTBF).alias("series"),
            F.lit(-1).cast("bigint").alias("us"),
            F.lit(-1).cast("bigint").alias("event_id"),
            F.lit(-1).cast("bigint").alias(SLICE),
            F.col("failed_at").alias("t"),
            F.lit(None).cast("bigint").alias("value"),
        )
        if self.carry:
            gaps = self._lifecycle(rows, clusters)
            carried = history.tbf_carry_last(gaps).where("us >= 0")
            costs = fresh.where(F.col("series") == policy.COST)
            live = policy.observe_carried(costs, carried).drop("seq")
        else:
            live = policy.observe(fresh.unionByName(before)).drop("seq")
        return history.restore(rings, live, self.history, SERIES, ORDER)

    @staticmethod
    def _lifecycle(rows: DataFrame, clusters: DataFrame) -> DataFrame:
        """STARTs, STOPs and failures of the batch after rows that lead to the stored state."""
        verb = F.col("verb")
        fresh = rows.where(verb.isin("START", "STOP", "UPDATE-MTBF")).select(
            "cluster",
            *ORDER,
            SLICE,
            F.when(verb == "UPDATE-MTBF", history.FAIL).otherwise(verb).alias("verb"),
            history.whole(F.trim("payload")).alias("t"),
        )
        anchor, stored = F.col("failed_at"), F.coalesce("elapsed", F.lit(0))

        def row(us: int, verb: str, t):
            return F.struct(F.lit(us).cast("bigint").alias("us"), F.lit(verb).alias("verb"), t.alias("t"))

        # a supervisor that ran for the stored time and stopped, and the anchor of one that runs
        stopped = [row(-3, history.START, anchor - stored), row(-2, history.STOP, anchor)]
        paused = [row(-3, history.START, anchor), row(-2, history.STOP, anchor + stored)]
        going = [*stopped, row(-1, history.START, anchor)]
        seeds = clusters.where(anchor.isNotNull()).select(
            "cluster",
            F.inline(F.when(F.coalesce("running", F.lit(True)), F.array(*going)).otherwise(F.array(*paused))),
        )
        return fresh.unionByName(
            seeds.withColumns(
                {"event_id": F.col("us"), SLICE: F.lit(-1).cast("bigint")}
            ).select(*fresh.columns)
        )

    def _clock(self, rows: DataFrame, clusters: DataFrame) -> DataFrame:
        """Anchor, stored time and running state of each cluster after the batch (with ``carry``)."""
        return history.failure_clock(self._lifecycle(rows, clusters)).select(
            "cluster", F.col("anchor").alias("_failed"), F.col("elapsed").alias("_elapsed"), F.col("running").alias("_running")
        )

    def _clusters(
        self,
        before: DataFrame,
        on_time: DataFrame,
        rows: DataFrame,
        announced: DataFrame,
        alerts: DataFrame,
    ) -> DataFrame:
        at = F.struct(*ORDER)
        last = on_time.groupBy("cluster").agg(F.max(at).alias("_at"))
        period = announced.groupBy("cluster").agg(
            F.max_by("period", F.struct(*ORDER, "kind")).alias("_period")
        )
        failed = (
            rows.where(F.col("verb") == "UPDATE-MTBF")
            .groupBy("cluster")
            .agg(F.max_by(history.whole(F.trim("payload")), at).alias("_failed"))
            .withColumns({"_elapsed": F.lit(None).cast("bigint"), "_running": F.lit(None).cast("boolean")})
        )
        if self.carry:
            failed = self._clock(rows, before)
        ram = alerts.groupBy("cluster").agg(F.max_by("ram", at).alias("_ram"))
        joined = before.join(last, "cluster", "full")
        for part in (period, failed, ram):
            joined = joined.join(part, "cluster", "left")
        return joined.select(
            "cluster",
            F.coalesce("_period", "period").alias("period"),
            F.coalesce("_failed", "failed_at").alias("failed_at"),
            F.coalesce("_at.us", "last_us").alias("last_us"),
            F.coalesce("_at.event_id", "last_event_id").alias("last_event_id"),
            F.coalesce("_ram", "ram").alias("ram"),
            F.coalesce("_elapsed", "elapsed").alias("elapsed"),
            F.coalesce("_running", "running").alias("running"),
        )



def skip_first_batches(folder: str, keys: list[str], schema: str):
    """``foreachBatch`` function that drops the first change of each key since the stream began.

    ``schema`` describes the key columns. The keys seen so far are a versioned table.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        seen = read_version(spark, f"{folder}/seen", schema, stream_of(df), batch)
        old = df.join(seen, keys, "left_semi")
        new = telemetry.skip_first_notice(df.join(seen, keys, "left_anti"), keys, ORDER)
        write_batch(old.unionByName(new), f"{folder}/notices", batch)
        write_version(seen.unionByName(df.select(*keys)).distinct(), f"{folder}/seen", batch)

    return write
