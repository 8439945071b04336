"""Named queries over the given tables: ``(spark, folder) -> DataFrame``.

Each query runs over whole tables. Computed numbers are rounded so that they can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacemark.functions import periods
from pacemark.functions.text import run_fields, seconds_after_equals
from pacemark.operators import (
    history,
    kvtree,
    lists,
    logs,
    policy,
    runs,
    snapshot,
    telemetry,
    workloads,
)
from pacemark.plans import bindings as b
from pacemark.plans.stateful import STATEFUL
from pacemark.session import cut
from pacemark.operators.ordered import last_known, previous, running_sum, scan
from pacemark.sources import text as sources
from pacemark.sources.text import EXEC_MARK, last_token_values

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {**STATEFUL}

RUN_BASELINE = 26.0
DAY = 86_400


def query(f: Query) -> Query:
    CATALOG[f.__name__] = f
    return f


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _int(name: str):
    return F.col(name).cast("int").alias(name)


# --- agent messages ---------------------------------------------------------------------------


@query
def parse_messages(spark, sf):
    parsed = telemetry.parse_messages(b.agent_messages(spark, sf))
    return parsed.select("event_id", "verb", "payload", "status")


@query
def roster_live(spark, sf):
    out = telemetry.roster(b.agent_rows(spark, sf))
    return out.select("event_id", "client", _int("live"), _int("accepted"))


@query
def client_latest(spark, sf):
    return telemetry.client_latest(b.agent_rows(spark, sf))


@query
def io_total(spark, sf):
    out = telemetry.io_total(b.agent_rows(spark, sf))
    return out.select("event_id", "cluster", _int("live"), "total")


@query
def io_step_period(spark, sf):
    out = policy.io_candidates(b.agent_rows(spark, sf))
    return out.select("event_id", "cluster", "total", "period")


@query
def io_period_changes(spark, sf):
    out = policy.without_repeats(
        policy.io_candidates(b.agent_rows(spark, sf)), "period", periods.PERIOD_START
    )
    return out.select("event_id", "cluster", "total", "period")


@query
def counter_rate(spark, sf):
    out = telemetry.counter_rate(b.counters(spark, sf))
    return out.where(F.col("rate").isNotNull()).select("event_id", "client", "counter", "rate")


@query
def rate_min_filter(spark, sf):
    out = telemetry.rate_filter(telemetry.counter_rate(b.counters(spark, sf)), 25)
    return out.select("event_id", "client", "rate")


@query
def ram_alerts(spark, sf):
    return telemetry.ram_alerts(b.ram_samples(spark, sf)).select("event_id", "cluster", "percent")


@query
def ram_alert_latest(spark, sf):
    broken = F.when(F.col("event_id") % 7 == 0, "x")
    payload = F.coalesce(broken, F.col("percent").cast("string"))
    alerts = telemetry.ram_alerts(b.ram_samples(spark, sf)).withColumn(
        "percent", telemetry.ram_percent(payload)
    )
    return telemetry.latest_per_key(alerts, "percent")


@query
def notify_skip_first(spark, sf):
    rows = b.events(spark, sf).where(F.col("event_type").isin("click", "error"))
    out = telemetry.skip_first_notice(rows, ["cluster", "event_type"])
    return out.select("event_id", "cluster", "event_type")


def _rollup(spark, sf, width, slide=None):
    rows = b.agent_rows(spark, sf).where(F.col("verb") == "UPDATE")
    out = telemetry.windowed(rows, "v", "ts", width, slide)
    return out.select(
        "cluster",
        F.unix_seconds("window_start").alias("window_start"),
        "n",
        "sum_rate",
        _r(F.col("avg_rate")).alias("avg_rate"),
        "max_rate",
    )


@query
def telemetry_tumbling(spark, sf):
    return _rollup(spark, sf, "6 hours")


@query
def telemetry_sliding(spark, sf):
    return _rollup(spark, sf, "6 hours", "2 hours")


@query
def late_rows(spark, sf):
    """Events that arrive up to two hours after they happened."""
    delay = F.pmod(F.col("event_id") * 7919, F.lit(7200)) * 1_000_000
    rows = b.events(spark, sf).withColumn("arrived", F.col("us") + delay)
    rows = b.sliced(rows.drop("slice"), ("arrived", "event_id"))
    out = telemetry.late_rows(rows, "us", ["arrived", "event_id"])
    return out.select("event_id", "cluster", _int("late"))


@query
def scan_null_keys(spark, sf):
    """Running columns where one cluster in eight has no number."""
    rows = b.events(spark, sf).withColumn("cluster", F.nullif("cluster", F.lit(3)))
    columns = {
        "total": running_sum(F.floor("value")),
        "known": last_known(F.when(F.col("event_type") == "error", F.col("event_id"))),
        "prior": previous(F.col("event_id")),
    }
    out = scan(rows, ["cluster"], ["us", "event_id"], columns)
    return out.select("event_id", "cluster", *columns)


# --- histories --------------------------------------------------------------------------------


@query
def value_truncation(spark, sf):
    signed = (F.col("value") - 50).cast("string")
    return b.events(spark, sf).select("event_id", history.whole(signed).alias("stored"))


@query
def ring_slots(spark, sf):
    out = history.ring_slots(b.observations(spark, sf).drop("seq"))
    return out.select("event_id", "cluster", "series", "value", "seq", "slot")


@query
def ring_current(spark, sf):
    out = history.ring_current(b.observations(spark, sf))
    return out.select("event_id", "cluster", "series", "value", "slot")


@query
def history_avg(spark, sf):
    out = history.history_avg(b.observations(spark, sf))
    return out.select("event_id", "cluster", "series", _r(F.col("avg_value")).alias("avg_value"))


@query
def tbf_simple(spark, sf):
    return history.tbf_simple(b.failures(spark, sf)).select("event_id", "cluster", "value")


@query
def tbf_carry_last(spark, sf):
    return history.tbf_carry_last(b.lifecycle(spark, sf)).select("event_id", "cluster", "value")


@query
def tbf_carry_accumulate(spark, sf):
    out = history.tbf_carry_accumulate(b.lifecycle(spark, sf))
    return out.select("event_id", "cluster", "value")


@query
def tbf_carry_offline(spark, sf):
    """Stored times of zero count too, as with the tool that closes a stopped supervisor."""
    out = history.tbf_carry_last(b.lifecycle(spark, sf), keep_nonpositive=True)
    return out.select("event_id", "cluster", "value")


@query
def restore_seed(spark, sf):
    """Half of the days form a stored ring; the history goes on from it."""
    middle = int(1.705276800e15)  # 2024-01-15 00:00 UTC
    rows = b.costs(spark, sf).withColumn("series", F.lit("checkpoint"))
    seeds = history.ring_current(rows.where(F.col("us") < middle))
    newest = seeds.groupBy("cluster", "series").agg(
        F.max_by("slot", F.struct("us", "event_id")).alias("pointer")
    )
    stored = seeds.join(newest, ["cluster", "series"])
    going_on = history.restore(stored, rows.where(F.col("us") >= middle))
    out = history.history_avg(going_on).where(~F.col("restored"))
    return out.select("event_id", "cluster", _r(F.col("avg_value")).alias("avg_value"))


@query
def restore_snapshot(spark, sf):
    """The same through snapshot documents: rings to nodes, nested, flattened and read back."""
    middle = int(1.705276800e15)
    rows = b.costs(spark, sf).withColumn("series", F.lit("checkpoint"))
    rings = history.ring_current(rows.where(F.col("us") < middle), 20)
    newest = rings.groupBy("cluster", "series").agg(
        F.max_by("slot", F.struct("us", "event_id")).alias("pointer")
    )
    stored = rings.join(newest, ["cluster", "series"])
    periods_now = newest.select("cluster", F.lit(periods.PERIOD_START).alias("period"))
    leaves = kvtree.with_inner_nodes(snapshot.to_nodes(stored, periods_now), ["cluster"])
    nodes = cut(kvtree.flatten(cut(kvtree.nest(leaves, ["cluster"])), ["cluster"]))
    going_on = history.restore(
        snapshot.rings_of(nodes), rows.where(F.col("us") >= middle), 20
    )
    means = history.history_avg(going_on, 20).where(~F.col("restored"))
    out = means.join(snapshot.clusters_of(nodes), "cluster")
    return out.select("event_id", "cluster", "period", _r(F.col("avg_value")).alias("avg_value"))


@query
def run_cost_snapshot(spark, sf):
    """Mean cost as known at the end of each run (a purchase)."""
    rows = b.events(spark, sf)
    means = history.history_avg(
        history.number(b.costs(spark, sf, rows), ["cluster"]), keys=["cluster"], name="avg_cost"
    )
    ends = rows.where(F.col("event_type") == "purchase")
    points = ends.select("cluster", "us", "event_id", "slice")
    out = history.value_at(points, means, "avg_cost")
    return out.select("event_id", "cluster", _r(F.col("avg_cost")).alias("avg_cost"))


# --- periods ----------------------------------------------------------------------------------


def _means(spark, sf, rows=None):
    return policy.averages(policy.observe(b.costs_and_failures(spark, sf, rows)))


def _formula(spark, sf, period):
    cost, mtbf = F.col("avg_cost") / 1000.0, F.col("avg_mtbf")
    rows = _means(spark, sf).where(cost.isNotNull() & mtbf.isNotNull())
    return rows.select("event_id", "cluster", _r(period(cost, mtbf)).alias("period"))


@query
def young(spark, sf):
    return _formula(spark, sf, periods.young)


@query
def daly_first(spark, sf):
    return _formula(spark, sf, lambda c, m: periods.daly_first(c, m, F.lit(10.0)))


@query
def daly_high(spark, sf):
    return _formula(spark, sf, periods.daly_high)


@query
def daly_high_compat(spark, sf):
    return _formula(spark, sf, periods.daly_high_compat)


@query
def period_candidates(spark, sf):
    return policy.candidates(_means(spark, sf)).select("event_id", "cluster", "period")


@query
def period_dedup(spark, sf):
    out = policy.without_repeats(policy.candidates(_means(spark, sf)), start=periods.PERIOD_START)
    return out.select("event_id", "cluster", "period")


@query
def period_deadband(spark, sf):
    out = policy.dead_band(policy.candidates(_means(spark, sf)))
    return out.select("event_id", "cluster", "period")


@query
def controller_combined(spark, sf):
    rows = b.events(spark, sf)
    out = policy.controller(
        policy.io_candidates(b.agent_rows(spark, sf, rows)),
        policy.candidates(_means(spark, sf, rows)),
    )
    return out.select("event_id", "cluster", "kind", "period")


def _carried_means(spark, sf, rows=None):
    rows = b.events(spark, sf) if rows is None else rows
    carried = history.tbf_carry_last(b.lifecycle(spark, sf, rows))
    return policy.averages(policy.observe_carried(b.costs(spark, sf, rows), carried))


@query
def period_from_carry(spark, sf):
    """Starts, stops and failures, through carried times, averages and Young's period, to announcements."""
    out = policy.dead_band(policy.candidates(_carried_means(spark, sf)))
    return out.select("event_id", "cluster", "period")


@query
def controller_with_carry(spark, sf):
    """The same together with the step table; odd clusters are static and have no computed periods."""
    rows = b.events(spark, sf)
    out = policy.controller(
        policy.io_candidates(b.agent_rows(spark, sf, rows)),
        policy.candidates(_carried_means(spark, sf, rows)),
        dynamic=F.col("cluster") % 2 == 0,
    )
    return out.select("event_id", "cluster", "kind", "period")


@query
def period_deadband_steady(spark, sf):
    out = policy.dead_band(b.steady_candidates(spark, sf))
    return out.select("event_id", "cluster", "period")


@query
def step_period_table(spark, sf):
    """Periods by a step table that is a DataFrame itself."""
    steps = spark.createDataFrame(periods.IO_STEPS, "threshold int, period int")
    totals = telemetry.io_total(b.agent_rows(spark, sf)).select("event_id", "us", "cluster", "total")
    out = policy.step_period_join(totals, steps, periods.IO_STEP_DEFAULT)
    return out.select("event_id", "cluster", "total", "period")


@query
def policy_gate(spark, sf):
    """Averages go on everywhere; periods are recommended in the dynamic clusters only."""
    out = policy.gated(policy.candidates(_means(spark, sf)), F.col("cluster") % 2 == 0)
    return out.select(
        "event_id", "cluster", _r(F.col("avg_mtbf")).alias("avg_mtbf"), "period"
    )


@query
def policy_compare(spark, sf):
    out = policy.compare_policies(_means(spark, sf))
    return out.select(
        "cluster",
        "policy",
        "n_candidates",
        "emits",
        _r(F.col("mean_period"), 4).alias("mean_period"),
        _r(F.col("mean_waste"), 4).alias("mean_waste"),
    )


# --- runs -------------------------------------------------------------------------------------

RUN_KEYS = ["benchmark", "phase", "rep"]


@query
def run_summary(spark, sf):
    out = runs.summary(b.runs(spark, sf), RUN_KEYS, "seconds")
    return out.select(*RUN_KEYS, "n", *[_r(F.col(c), 4).alias(c) for c in ("mean", "pstdev")])


@query
def run_grouped_median(spark, sf):
    out = runs.grouped_median(b.runs(spark, sf), RUN_KEYS, "seconds")
    return out.select(*RUN_KEYS, "n", _r(F.col("grouped_median"), 4).alias("grouped_median"))


@query
def run_overhead(spark, sf):
    """Against a fixed run time and against the runs before the failure."""
    stats = runs.summary(b.runs(spark, sf), ["benchmark", "phase"], "seconds")
    fixed = runs.overhead(stats, RUN_BASELINE).withColumnRenamed("overhead", "over_fixed")
    out = runs.overhead_to_group(fixed, F.col("phase") == "AF", ["benchmark"])
    return out.select(
        "benchmark",
        "phase",
        _r(F.col("over_fixed"), 4).alias("over_fixed"),
        (_r(F.col("overhead"), 4) + 0.0).alias("over_af"),
    )


@query
def run_margin(spark, sf):
    stats = runs.summary(b.runs(spark, sf), RUN_KEYS, "seconds")
    fixed_n = runs.margin(stats, compat=True).withColumnRenamed("margin", "margin20")
    out = runs.margin(fixed_n.drop("low", "high"))
    columns = ("margin20", "margin", "low", "high")
    return out.select(*RUN_KEYS, *[_r(F.col(c), 4).alias(c) for c in columns])


@query
def run_lines_parse(spark, sf):
    """Result lines in two of the formats, read back."""
    phase, rep, s = F.col("phase"), F.col("rep"), F.col("seconds")
    line = F.when(
        rep % 3 == 0, F.concat(F.lit(">> Run "), rep, F.lit(" >> "), s, F.lit(" s."))
    ).otherwise(
        F.concat(F.lit("TestDFSIO ("), phase, F.lit(") #"), rep, F.lit(" = "), s, F.lit(" seg."))
    )
    lines = b.runs(spark, sf).select("l_orderkey", "l_linenumber", line.alias("text"))
    text = F.col("text")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        *[c.alias(n) for n, c in run_fields(text).items() if n != "checkpoint_s"],
        seconds_after_equals(text).alias("after_equals"),
    )


@query
def run_labels(spark, sf):
    """Result lines in all formats, with titles and profiles of their files."""
    good, _ = sources.run_lines_with_headers(b.label_lines(spark, sf), slice_col=None)
    columns = ("file", "line_id", "benchmark", "phase", "checkpoint_s", "rep", "seconds", "profile")
    return good.select(*columns)


@query
def report_fields(spark, sf):
    """Report blocks; times in a zone that is not known have no value."""
    out = sources.report_fields(sources.split_reports(b.report_texts(spark, sf)))
    numbers = ("n_files", "total_mb", "throughput", "avg_io", "io_std", "exec_s")
    return out.select("l_orderkey", "op", F.unix_seconds("run_ts").alias("run_s"), *numbers)


@query
def step_table(spark, sf):
    return sources.step_table(b.step_texts(spark, sf))


@query
def last_token(spark, sf):
    rows = b.runs(spark, sf)
    line = F.when(F.col("rep") % 2 == 0, F.lit("       Number of files: 2")).otherwise(
        F.concat(F.lit("    Test exec time sec: "), "mb")
    )
    lines = rows.select("l_orderkey", "l_linenumber", line.alias("text"))
    good, _ = last_token_values(lines, EXEC_MARK)
    return good.select("l_orderkey", "l_linenumber", _r(F.col("value"), 4).alias("value"))


@query
def run_duration(spark, sf):
    starts = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("s")
    )
    ends = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("e")
    )
    return runs.durations(starts, ends, ["run"], "s", "e")


@query
def phase_compare(spark, sf):
    out = runs.phase_comparison(b.runs(spark, sf), ["benchmark", "rep"], "seconds")
    columns = ("mean_af", "mean_df", "ratio")
    return out.select("benchmark", "rep", *[_r(F.col(c), 4).alias(c) for c in columns])


@query
def checkpoint_compare(spark, sf):
    """Runs with a checkpoint period of an hour against those with ten seconds."""
    rows = b.runs(spark, sf).withColumn(
        "checkpoint_s", F.when(F.col("l_orderkey") % 2 == 0, 3600).otherwise(10)
    )
    out = runs.phase_comparison(rows, ["benchmark"], "seconds", (3600, 10), "checkpoint_s")
    columns = ("mean_3600", "mean_10", "ratio")
    return out.select("benchmark", *[_r(F.col(c), 4).alias(c) for c in columns])


@query
def io_consistency(spark, sf):
    """Reports of all orders checked against their own rates, some of them with a wrong throughput."""
    pairs = runs.io_summary(b.runs(spark, sf), ["l_orderkey"], "mb", "seconds")
    wrong = F.when(F.col("l_orderkey") % 5 == 0, 1.01).otherwise(1.0)
    # two files of one size: their rates fit the throughput; others need not
    equal = b.runs(spark, sf).groupBy("l_orderkey").agg(F.max("seconds").alias("a"), F.min("seconds").alias("z"))
    rate_a, rate_z = 512.0 / F.col("a"), 512.0 / F.col("z")
    even = equal.select(
        "l_orderkey",
        ((rate_a + rate_z) / 2).alias("avg_io"),
        (F.abs(rate_a - rate_z) / 2).alias("io_std"),
        (wrong * 1024.0 / (F.col("a") + F.col("z"))).alias("throughput"),
    )
    out = runs.io_consistent(even).join(
        runs.io_consistent(pairs).select("l_orderkey", F.col("consistent").alias("uneven")), "l_orderkey"
    )
    return out.select(
        "l_orderkey", _r(F.col("throughput"), 4).alias("throughput"), _int("consistent"), _int("uneven")
    )


@query
def io_summary(spark, sf):
    out = runs.io_summary(b.runs(spark, sf), ["benchmark", "phase"], "mb", "seconds")
    columns = ("total_mb", "throughput", "avg_io", "io_std")
    return out.select("benchmark", "phase", "n_tasks", *[_r(F.col(c), 2).alias(c) for c in columns])


# --- logs -------------------------------------------------------------------------------------

PATTERN = "the "


def _counts(spark, sf):
    files = b.table(spark, sf, "documents").select("doc_id")
    return logs.pattern_counts(b.document_lines(spark, sf), files, PATTERN, ["doc_id"])


@query
def file_lines(spark, sf):
    """Numbered lines with a bar of every document, and one row for each document without any."""
    files = b.table(spark, sf, "documents").select(F.col("doc_id").alias("file"))
    lines = b.document_lines(spark, sf).where(F.col("text").contains("|"))
    lines = lines.select(F.col("doc_id").alias("file"), F.lit(0).alias("block"), F.col("pos").alias("line_id"), "text")
    out = logs.with_empty_files(sources.number_lines(lines), files)
    return out.select("file", "line_no", F.length("text").alias("n_chars"))


@query
def pattern_count_file(spark, sf):
    return _counts(spark, sf)


@query
def pattern_mean(spark, sf):
    out = logs.pattern_mean(_counts(spark, sf))
    return out.select("n_files", _r(F.col("mean_cnt"), 4).alias("mean_cnt"))


@query
def pattern_cumulative_mean(spark, sf):
    out = logs.cumulative_mean(_counts(spark, sf), "doc_id")
    return out.select("n_files", _r(F.col("mean_cnt")).alias("mean_cnt"))


@query
def token_mean(spark, sf):
    text = F.concat(
        F.lit("2024-01-01 00:00:00,000 "),
        # a line of another level is not counted
        F.when(F.col("event_type") == "view", logs.EDITS_LOADED.replace("INFO", "WARN")).otherwise(logs.EDITS_LOADED),
        F.lit(" /e of size "),
        "event_id",
        F.lit(" edits # "),
        F.floor("value"),
        F.lit(" loaded in 0 seconds"),
    )
    out = logs.token_mean(b.events(spark, sf).select(text.alias("text")))
    return out.select("n_lines", _r(F.col("mean_token"), 4).alias("mean_token"))


@query
def clean_lines(spark, sf):
    return logs.clean(b.document_lines(spark, sf), ["the ", "License", "@"])


@query
def log_records(spark, sf):
    """Events as log lines, errors with two continuation lines, parsed and folded per cluster."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    level = F.when(F.col("event_type") == "error", "WARN").otherwise("INFO")
    head = F.concat(
        stamp, F.lit(" [myid:"), "cluster", F.lit("] - "), F.rpad(level, 5, " "),
        F.lit(" [main:"), F.initcap("event_type"), F.lit("@"), "client", F.lit("] - event "), "event_id",
    )
    trace = F.when(
        F.col("event_type") == "error",
        F.array(head, F.lit("java.io.IOException: lost"), F.lit("\tat a.B.c(B.java:1)")),
    ).otherwise(F.array(head))
    lines = b.events(spark, sf).select(
        "cluster", "us", "event_id", "slice", F.posexplode(trace).alias("pos", "text")
    )
    out = logs.fold_records(
        logs.number_records(lines, ["us", "event_id", "pos"], ["cluster"]), ["cluster"]
    )
    return out.select(
        "cluster",
        "record_no",
        F.unix_millis("ts").alias("ms"),
        "myid",
        "level",
        "thread",
        "class",
        "src_line",
        "message",
        "n_more",
    )


@query
def severity_rollup(spark, sf):
    out = logs.severity_rollup(b.events(spark, sf), "event_type", "ts", "1 day", ["cluster"])
    return out.select("cluster", "event_type", F.unix_seconds("bucket").alias("bucket"), "n")


@query
def session_lifetimes(spark, sf):
    rows = b.events(spark, sf).withColumns(
        {"up": F.col("event_type") == "signup", "down": F.col("event_type") == "error"}
    )
    return logs.sessions(rows, "client", "up", "down", "t")


# --- key–value snapshots ----------------------------------------------------------------------


@query
def kv_nest(spark, sf):
    return kvtree.nest(b.snapshot_nodes(spark, sf))


@query
def kv_flatten(spark, sf):
    return kvtree.flatten(cut(kvtree.nest(b.snapshot_nodes(spark, sf))))


@query
def kv_nest_region(spark, sf):
    """Leaves alone, one snapshot per region; the nodes above them are added."""
    return kvtree.nest(b.region_nodes(spark, sf))


@query
def kv_flatten_texts(spark, sf):
    """Whole documents as values, nested and flattened again."""
    flat = kvtree.flatten(cut(kvtree.nest(b.document_nodes(spark, sf))))
    return flat.select("snapshot", "depth", "path", F.md5(F.col("value").cast("binary")).alias("value"))


@query
def kv_upsert(spark, sf):
    keys = ["snapshot", "path"]
    return kvtree.upsert(b.earlier_leaves(spark, sf), b.later_leaves(spark, sf), keys)


@query
def kv_diff(spark, sf):
    keys = ["snapshot", "path"]
    return kvtree.diff(b.earlier_leaves(spark, sf), b.later_leaves(spark, sf), keys)


# --- workloads and lists ----------------------------------------------------------------------


@query
def wordcount(spark, sf):
    return workloads.wordcount(b.table(spark, sf, "documents").select("text"))


@query
def pagerank(spark, sf):
    out = workloads.pagerank(b.trade_edges(spark, sf), 3)
    return out.select("node", _r(F.col("rank")).alias("rank"))


@query
def terasort_check(spark, sf):
    """Position of every line item in the total order by ship date and key."""
    rows = b.table(spark, sf, "lineitem").select(
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("s"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_partkey",
    )
    order = ("s", "k", "l_partkey", "l_suppkey")
    out = workloads.sort_positions(b.sliced(rows, ("s", "k")), order)
    return out.select("pos", "l_orderkey", "l_linenumber")


@query
def total_sort(spark, sf):
    """Line items in total order: rows, and neighbouring partitions that overlap."""
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    checked = workloads.sort_check(workloads.total_sort(b.table(spark, sf, "lineitem"), order), order)
    return checked.select("n_rows", "overlaps")


@query
def pi_hash(spark, sf):
    """Points hashed from the line items, so that the estimate can be checked."""
    rows = b.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k")
    )
    first = rows.select(
        b.hashed_unit(F.col("k"), 1).alias("x"), b.hashed_unit(F.col("k"), 9).alias("y")
    )
    second = rows.select(
        b.hashed_unit(F.col("k"), 17).alias("x"), b.hashed_unit(F.col("k"), 25).alias("y")
    )
    out = workloads.pi_estimate(first, second)
    return out.select("n", "hits", "sevens", _r(F.col("pi")).alias("pi"))


@query
def uniq_consecutive(spark, sf):
    rows = b.events(spark, sf)
    out = lists.uniq_consecutive(rows, "event_type", ["cluster"], ["us", "event_id"])
    return out.select("event_id", "cluster", "event_type")


@query
def fixed_batches(spark, sf):
    rows = b.events(spark, sf).select("event_id", "us", "slice")
    out = lists.fixed_batches(rows, 64, 100, ["us", "event_id"])
    return out.select("event_id", "batch", "place")


@query
def batch_capacity(spark, sf):
    return lists.batch_capacity(b.events(spark, sf), 64, 20, ["cluster"])


@query
def seq_ids(spark, sf):
    rows = b.table(spark, sf, "orders").select("o_orderkey")
    out = lists.sequence_ids(b.sliced(rows, ("o_orderkey",)), ["o_orderkey"])
    return out.select("myid", "o_orderkey")


@query
def nth_per_group(spark, sf):
    """First and second order of each customer: main and secondary host of a job."""
    rows = b.table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    two = lists.nth_per_group(rows, [1, 2], ["o_custkey"], ["o_orderdate", "o_orderkey"])
    host = F.col("o_orderkey")
    return two.groupBy("o_custkey").agg(
        F.max(F.when(F.col("nth") == 1, host)).alias("main"),
        F.max(F.when(F.col("nth") == 2, host)).alias("secondary"),
    )

