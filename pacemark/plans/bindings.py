"""The given tables as inputs of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacemark.operators import history
from pacemark.operators.kvtree import with_inner_nodes
from pacemark.operators.ordered import Slices, running_sum, scan
from pacemark.operators.policy import observe

CLUSTERS = 8
SUPPLIERS_PER_SNAPSHOT = 50


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sliced(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Add slices, planned from the rows as they are now."""
    return Slices.plan(df, order).assign(df)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of clusters and clients in microseconds ``us`` and seconds ``t``, with slices."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    base = table(spark, sf, "events").select(
        "event_id",
        us.alias("us"),
        (F.col("user_id") % CLUSTERS).alias("cluster"),
        F.col("user_id").alias("client"),
        "event_type",
        "value",
    )
    rows = sliced(base, ("us", "event_id"))
    return rows.withColumns(
        {
            "t": F.expr("us div 1000000"),
            "ts": F.timestamp_micros("us"),
        }
    )


def _verb(pairs: dict[str, str], other: str | None = None) -> Column:
    kind = F.col("event_type")
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for event, verb in pairs.items():
        chain = chain.when(kind == event, verb)
    return chain.otherwise(F.lit(other))


def agent_rows(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Registrations, removals and I/O rates ``v``; ``rows``: events that are at hand with their slices."""
    rows = events(spark, sf) if rows is None else rows
    return rows.select(
        "cluster",
        "client",
        "us",
        "event_id",
        "slice",
        "ts",
        _verb({"signup": "IN", "error": "OUT"}, "UPDATE").alias("verb"),
        F.floor("value").alias("v"),
    )


def agent_messages(spark: SparkSession, sf: str) -> DataFrame:
    """`agent_rows` as message texts, some of them malformed."""
    i = F.col("event_id")
    msg = (
        F.when(i % 97 == 0, "UPDATE")
        .when(i % 101 == 0, "HELLO")
        .when(i % 103 == 0, "UPDATE-RAM:x")
        .when(i % 107 == 0, F.concat(F.lit("UPDATE:"), F.floor("value"), F.lit(":9")))
        .when(i % 109 == 0, "UPDATE:1a")
        .when(i % 113 == 0, F.concat(F.lit("UPDATE-CC:"), F.floor("value")))
        .when(i % 127 == 0, F.concat(F.lit("UPDATE-MTBF:"), "t"))
        .when(F.col("event_type") == "signup", "IN")
        .when(F.col("event_type") == "error", "OUT")
        .otherwise(F.concat(F.lit("UPDATE:"), F.floor("value")))
    )
    return events(spark, sf).withColumn("msg", msg)


def lifecycle(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Starts, stops and failures of supervisors."""
    verb = _verb({"signup": "START", "purchase": "STOP", "error": "FAIL"})
    rows = events(spark, sf) if rows is None else rows
    rows = rows.where(F.col("event_type").isin("signup", "purchase", "error"))
    return rows.select("cluster", "us", "event_id", "slice", "t", verb.alias("verb"))


def costs(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Checkpoint costs in ms."""
    rows = events(spark, sf) if rows is None else rows
    return rows.where(F.col("event_type") == "click").select(
        "cluster", "us", "event_id", "slice", history.whole(F.col("value") * 1000).alias("value")
    )


def failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).where(F.col("event_type") == "error")
    return rows.select("cluster", "us", "event_id", "slice", "t")


def costs_and_failures(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Both series of the history before the times between failures are known."""
    rows = events(spark, sf) if rows is None else rows
    rows = rows.where(F.col("event_type").isin("click", "error"))
    is_cost = F.col("event_type") == "click"
    return rows.select(
        "cluster",
        F.when(is_cost, "checkpoint").otherwise("mtbf").alias("series"),
        "us",
        "event_id",
        "slice",
        "t",
        F.when(is_cost, history.whole(F.col("value") * 1000)).alias("value"),
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Costs and times between failures as one history per cluster and series."""
    return observe(costs_and_failures(spark, sf))


def ram_samples(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).where(F.col("event_type") == "view")
    return rows.select(
        "cluster", "client", "us", "event_id", F.least("value", F.lit(100.0)).alias("percent")
    )


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative write counters per client."""
    step = F.floor(F.col("value") * 100000)
    rows = events(spark, sf).select("cluster", "client", "us", "event_id", "slice", "t", "value")
    return scan(
        rows, ["cluster", "client"], ["us", "event_id"], {"counter": running_sum(step)}
    ).drop("value")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark runs."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_returnflag").alias("benchmark"),
        F.when(F.col("l_linestatus") == "O", "AF").otherwise("DF").alias("phase"),
        F.col("l_linenumber").alias("rep"),
        F.col("l_quantity").cast("int").alias("seconds"),
        F.col("l_extendedprice").alias("mb"),
    )


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: one row per line, in whole."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def supplier_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as leaves ``/region/nation/supplier/``; a snapshot has a fixed number of them."""
    suppliers = table(spark, sf, "supplier")
    nations = table(spark, sf, "nation")
    regions = table(spark, sf, "region")
    path = F.concat(
        F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), F.trim("s_name"), F.lit("/")
    )
    return (
        suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.floor(F.col("s_suppkey") / SUPPLIERS_PER_SNAPSHOT).alias("snapshot"),
            "s_suppkey",
            "s_acctbal",
            path.alias("path"),
            F.col("s_suppkey").cast("string").alias("value"),
        )
    )


def snapshot_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return with_inner_nodes(supplier_paths(spark, sf))


def earlier_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """The leaves of a first snapshot: suppliers of the highest balances are not there yet."""
    return supplier_paths(spark, sf).where(F.col("s_acctbal") < 8000)


def later_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """The leaves of a second snapshot: suppliers in debt are gone, rich ones have another value."""
    rows = supplier_paths(spark, sf).where(F.col("s_acctbal") >= 0)
    changed = F.when(F.col("s_acctbal") >= 5000, F.concat("value", F.lit("x")))
    return rows.withColumn("value", F.coalesce(changed, "value"))


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct edges between customers and suppliers (negative numbers), in both directions."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src")
    )
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", (-F.col("l_suppkey") - 1).alias("dst")
    )
    one_way = orders.join(lines, "l_orderkey").select("src", "dst").distinct()
    both = F.explode(
        F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    )
    return one_way.select(both.alias("e")).select("e.src", "e.dst")


def hashed_unit(text: Column, start: int) -> Column:
    """A number in [0, 1) from eight hex digits of the MD5 of a text."""
    digits = F.substring(F.md5(text), start, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))


def steady_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Periods of two clusters that stay within a second and rarely move on."""
    rows = events(spark, sf).withColumn("cluster", F.col("cluster") % 2)
    level = 800 + 7 * F.expr("event_id div 2000") + F.floor("value") % 3
    return rows.select("cluster", "us", "event_id", "slice", level.alias("period"))


def region_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """One snapshot per region, with the leaves only."""
    region = F.regexp_extract("path", "^/([^/]+)/", 1)
    return supplier_paths(spark, sf).select(region.alias("snapshot"), "path", "value")


def document_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """One snapshot per document with its whole text as a value."""
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit("/"))
    return docs.select(F.col("doc_id").alias("snapshot"), path.alias("path"), F.col("text").alias("value"))


def report_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The items of an order as one text of reports, with and without empty lines between them."""
    number = F.col("l_linenumber")
    zone = F.when(number % 3 == 0, "BRT").when(number % 3 == 1, "UTC").otherwise("CET")
    day = F.col("l_shipdate").cast("timestamp")
    block = F.concat(
        F.lit("----- TestDFSIO ----- : "), F.when(number % 2 == 0, "read").otherwise("write"),
        F.lit("\n           Date & time: "), F.date_format(day, "EEE MMM dd HH:mm:ss "), zone,
        F.date_format(day, " yyyy"), F.lit("\n       Number of files: "), number,
        F.lit("\nTotal MBytes processed: "), "l_extendedprice",
        F.lit("\n     Throughput mb/sec: "), "l_quantity",
        F.lit("\nAverage IO rate mb/sec: "), "l_discount",
        F.lit("\n IO rate std deviation: "), F.when(number == 4, "none").otherwise(F.col("l_tax").cast("string")),
        F.lit("\n    Test exec time sec: "), "l_partkey", F.lit("\n"),
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.struct(number.alias("n"), block.alias("b")).alias("s"))
    parted = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["b"]), "~")
    gap = F.when(F.col("l_orderkey") % 2 == 0, "\n").otherwise("")
    return (
        rows.groupBy("l_orderkey")
        .agg(parted.alias("text"))
        .withColumn("text", F.concat(F.lit("head\n"), F.call_function("replace", "text", F.lit("~"), gap)))
    )


def label_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Result lines of all formats, one file per order that begins with a title and a profile line."""
    rep = F.col("rep")
    kind = (F.col("l_orderkey") + rep) % 7
    text = (
        F.when(kind == 0, F.concat(F.lit("TeraGen #"), rep, F.lit(" = "), "seconds", F.lit(" seg.")))
        .when(kind == 1, F.concat(F.lit("TestDFSIO ("), "phase", F.lit(") #"), rep, F.lit(" = "), "seconds", F.lit(" seg.")))
        .when(kind == 2, F.concat(F.lit("TestDFSIO-3600 #"), rep, F.lit(" = "), "seconds", F.lit(" seg.")))
        .when(kind == 3, F.concat(F.lit("["), "phase", F.lit("] TestDFSIOe #"), rep, F.lit(" = "), "seconds", F.lit(" sec.")))
        .when(kind == 4, F.concat(F.lit("Spark HiBench ("), "phase", F.lit(") #"), rep, F.lit(" = "), "seconds", F.lit(" seg.")))
        .when(kind == 5, F.concat(F.lit("#"), rep, F.lit(" = "), "seconds", F.lit(" s.")))
        .otherwise(F.concat(F.lit(">> Run "), rep, F.lit(" >> "), "seconds", F.lit(" s.")))
    )
    lines = runs(spark, sf).select(F.col("l_orderkey").alias("file"), rep.cast("bigint").alias("line_id"), text.alias("text"))
    head = F.explode(
        F.array(
            F.struct(F.lit(-2).alias("i"), F.lit("------ PageRank benchmark ------").alias("x")),
            F.struct(F.lit(-1).alias("i"), F.lit("Profile: large").alias("x")),
        )
    )
    files = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), head.alias("h"))
    titles = files.where("file % 3 <> 0").select("file", F.col("h.i").cast("bigint").alias("line_id"), F.col("h.x").alias("text"))
    return lines.unionByName(titles)


def step_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Step tables as texts, one per customer."""
    pair = F.concat_ws(": ", F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string"))
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(pair).alias("p"))
    return rows.select("o_custkey", F.concat(F.lit("{"), F.array_join("p", ", "), F.lit(", -1: 500}")).alias("text"))
