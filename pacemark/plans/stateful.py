"""Queries whose operators keep state: streams over the given tables, worked off in whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacemark.operators import activity, kvrecursive, kvtext, kvtree, quantiles, runs, workloads
from pacemark.plans import bindings as b
from pacemark.session import cut, settings
from pacemark.sources import logsource
from pacemark.sources.changelog import ChangeLog
from pacemark.sources.sinks import without_repeats
from pacemark.streaming.live import STATE_SETTINGS, notices
from pacemark.streaming.run import read_stream, run_to_table, stream_folder
from pacemark.streaming.spans import run_spans

STATEFUL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TIMEOUT_US = 12 * 3600 * 1_000_000
GAP = "6 hours"
#: Largest error of a month's sketched median of 50 quantities, some 2.5 % of the ranks to either side.
BOUND = 1.25


def query(f):
    STATEFUL[f.__name__] = f
    return f


def table_stream(spark: SparkSession, sf: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    b.table(spark, sf, name)  # sets the time zone
    return read_stream(spark, f"{sf}/{name}.parquet", files_per_batch)


def client_messages(events: DataFrame) -> DataFrame:
    """Registrations, removals and rates of clients, from a table or stream of events."""
    kind, ts = F.col("event_type"), F.col("ts").cast("timestamp")
    return events.select(
        (F.col("user_id") % b.CLUSTERS).alias("cluster"),
        F.col("user_id").alias("client"),
        ts.alias("ts"),
        F.unix_micros(ts).alias("us"),
        "event_id",
        F.when(kind == "signup", "IN").when(kind == "error", "OUT").otherwise("UPDATE").alias("verb"),
        F.floor("value").alias("v"),
    )


def restored_clients(messages: DataFrame) -> DataFrame:
    """Every third client is known from a snapshot, last heard of an hour before its first message."""
    seen = messages.where(F.col("client") % 3 == 0).groupBy("cluster", "client")
    return seen.agg(F.expr("min(us) - 3600000000").alias("last_us")).withColumn("latest", F.col("client"))


@query
def live_notices(spark, sf):
    restored = restored_clients(client_messages(b.table(spark, sf, "events")))
    messages = client_messages(table_stream(spark, sf, "events"))
    with settings(spark, **STATE_SETTINGS):
        return run_to_table(notices(messages, TIMEOUT_US, "10 minutes 0.5 seconds", restored))


@query
def run_spans_stream(spark, sf):
    """Orders as starts, their items' shipping as ends."""
    starts = table_stream(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run"), F.col("o_orderdate").cast("timestamp").alias("start_ts")
    )
    ends = table_stream(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run"), "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("end_ts")
    )
    with settings(spark, **STATE_SETTINGS):
        found = run_to_table(run_spans(starts, ends, ["run"], "60 days", "12 hours"))
    return found.select("run", "l_linenumber", "seconds", "status")


def _micros(found: DataFrame) -> DataFrame:
    return found.select(
        "client", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "n"
    )


@query
def client_sessions(spark, sf):
    return _micros(activity.sessions(b.events(spark, sf), ["client"], "ts", GAP))


@query
def client_sessions_stream(spark, sf):
    messages = client_messages(table_stream(spark, sf, "events"))
    merged = activity.session_stream(messages, ["client"], "ts", GAP, "10 minutes 0.5 seconds")
    local = {"streaming__sessionWindow__merge__sessions__in__local__partition": "true"}
    with settings(spark, **STATE_SETTINGS, **local):
        return _micros(run_to_table(merged))


@query
def kv_nest_pieces(spark, sf):
    """One snapshot per region, written in pieces of 512 characters."""
    out = kvtext.nest_pieces(b.region_nodes(spark, sf), size=512)
    return out.select("snapshot", "piece", "text")


@query
def kv_nest_all_documents(spark, sf):
    """All documents as leaves of a single snapshot, in pieces of 16,384 characters."""
    docs = b.table(spark, sf, "documents")
    path = F.concat_ws("/", F.lit(""), "lang", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(""))
    nodes = docs.select(F.lit(1).alias("snapshot"), path.alias("path"), F.md5(F.col("text").cast("binary")).alias("value"))
    return kvtext.nest_pieces(nodes, size=16_384).select("piece", "text")


def latest_order_batches(spark, sf):
    """Ten batches of changes in the order of time: each customer's latest order."""
    day = F.col("o_orderdate").cast("timestamp")
    months = (F.year(day) - 1995) * 12 + F.month(day) - 1
    return b.table(spark, sf, "orders").select(
        F.greatest(F.lit(0), F.least(F.lit(9), F.floor(months / 8))).cast("int").alias("batch"),
        F.concat(F.lit("/customer/"), "o_custkey", F.lit("/")).alias("path"),
        F.col("o_orderkey").cast("string").alias("value"),
        F.unix_micros(day).alias("us"),
        F.col("o_orderkey").alias("event_id"),
    )


@query
def kv_upsert_log(spark, sf):
    """State after ten batches of changes, appended to a log and compacted bucket by bucket."""
    changes = latest_order_batches(spark, sf)
    log = ChangeLog(f"{stream_folder(spark)}/latest", buckets=8)
    for batch in range(10):
        log.write(changes.where(F.col("batch") == batch), batch, "orders")
        log.compact(spark)
    log.vacuum(spark)
    return log.read(spark).select("path", "value", F.col("number").alias("batch"))


@query
def kv_flatten_recursive(spark, sf):
    """Documents under the digits of their ids, so of unequal depth, nested and flattened again."""
    docs = b.table(spark, sf, "documents")
    path = F.concat(F.lit("/"), F.array_join(F.split(F.col("doc_id").cast("string"), ""), "/"), F.lit("/"))
    nodes = docs.select(
        F.expr("doc_id div 500").alias("snapshot"), path.alias("path"), F.md5(F.col("text").cast("binary")).alias("value")
    )
    return kvrecursive.flatten(cut(kvtree.nest(nodes)))


@query
def log_source_lines(spark, sf):
    """Documents written as numbered log files, 200 in each, and read by the log source."""
    docs = b.table(spark, sf, "documents").where(F.col("text").isNotNull())
    lines = docs.select(
        F.expr("doc_id div 200").alias("file_no"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value")
    )
    folder = f"{stream_folder(spark)}/logs"
    order = ["file_no", "doc_id", "pos"]
    laid = lines.repartition("file_no").sortWithinPartitions(*order)
    laid.select("file_no", "value").write.partitionBy("file_no").text(folder)
    logsource.register(spark)
    read = spark.read.format(logsource.FORMAT).option("path", folder).option("name", r"file_no=([0-9]+)/part-").load()
    hit = F.when(F.col("text").contains("the "), F.col("line_no"))
    return read.groupBy("file_no").agg(
        F.count("*").alias("n_lines"), F.max("line_no").alias("last_line"), F.count(hit).alias("hits"),
        F.min(hit).alias("first_hit"), F.sum(F.length("text")).alias("n_chars"),
    )


@query
def grouped_median_sketch(spark, sf):
    """Grouped medians per month from daily sketches, held against the exact ones."""
    rows = b.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("benchmark"), "l_shipdate", F.col("l_quantity").cast("int").alias("seconds")
    )
    month = F.date_format("l_shipdate", "yyyy-MM")
    daily = quantiles.sketches(rows, ["benchmark", "l_shipdate"], "seconds")
    monthly = quantiles.merged(daily.withColumn("month", month), ["benchmark", "month"])
    near = quantiles.grouped_median(monthly).withColumnRenamed("grouped_median", "near")
    exact = runs.grouped_median(rows.withColumn("month", month), ["benchmark", "month"], "seconds")
    both = near.drop("sketch").join(exact.drop("n"), ["benchmark", "month"])
    off = F.abs(F.col("near") - F.col("grouped_median"))
    return both.select(
        "benchmark", "month", "n", F.round("grouped_median", 6).alias("grouped_median"), (off <= BOUND).alias("within")
    )


@query
def phase_subtotals(spark, sf):
    out = runs.phase_subtotals(b.runs(spark, sf), ["benchmark", "rep"], "seconds")
    return out.select(
        "benchmark", F.col("rep").cast("int").alias("rep"), F.col("grouping").cast("int").alias("grouping"), "n",
        *[F.round(c, 6).alias(c) for c in ("mean_af", "mean_df", "ratio")],
    )


@query
def transfer_write(spark, sf):
    """Line items rewritten as text in 16 folders: rows and bytes as observed and as found in the files."""
    rows = b.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 16).alias("part"),
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus").alias("line"),
    )
    return workloads.observed_write(rows, f"{stream_folder(spark)}/rewritten", "part")


@query
def stream_without_repeats(spark, sf):
    """Every fifth event comes again, some seconds later; the sink has each once."""
    events = client_messages(b.table(spark, sf, "events"))
    times = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    folder = stream_folder(spark)
    sent = events.withColumn("s", F.explode(times))
    sent.withColumn("ts", F.timestamp_micros(F.col("us") + F.col("s") * 1_000_000)).drop("s").write.parquet(f"{folder}/sent")
    with settings(spark, **STATE_SETTINGS):
        kept = run_to_table(without_repeats(read_stream(spark, f"{folder}/sent"), ["cluster", "event_id"]), folder)
    return kept.select("cluster", "event_id", "verb", "v")
