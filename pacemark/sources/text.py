"""Readers of text files: daemon logs, result lines, report blocks, step tables.

All of them read through ``spark.read``, so large files are split. Rejected lines are kept in a second
DataFrame instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacemark.functions.text import last_token_double, run_fields, seconds_after_equals
from pacemark.operators.logs import carry_headers
from pacemark.operators.ordered import row_number, scan

# File names of the daemon logs, offsets of zone names, labels of report lines.
NAMENODE_LOGS = r"log-nn-([0-9]+).txt"
SECONDARY_LOGS = r"log-snn-([0-9]+).txt"
CUMULATIVE_LOGS = r"nn([0-9]+).log"
ZONES = {"BRT": "-03:00", "UTC": "+00:00", "GMT": "+00:00"}
REPORT_HEADER = "----- TestDFSIO ----- : "
HEADERS = {
    "header_benchmark": r"^-+ (\w+) benchmark -+$",
    "profile": r"^Profile: (\S+)$",
}
EXEC_MARK = "Test exec"

LINE_ORDER = ("line_id",)
LINE_SLICE = "block"


def log_files(spark: SparkSession, folder: str, name: str = ".*") -> DataFrame:
    """Files whose name begins with the pattern, also those without any byte.

    Spark's own readers leave empty files out, so names and sizes come from the file system's listing,
    which a reader keeps on the driver as well.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [
        (s.getPath().getName(), s.getLen()) for s in fs.listStatus(path) if s.isFile()
    ]
    file = F.col("file")
    return (
        spark.createDataFrame(listed, "file string, length bigint")
        .where(file.rlike(f"^(?:{name})"))
        .select(file, _file_no(file, name).alias("file_no"), "length")
    )


def _file_no(file, name: str):
    if "(" not in name:
        return F.lit(None).cast("int")
    return F.nullif(F.regexp_extract(file, f"^(?:{name})", 1), F.lit("")).try_cast("int")


def log_lines(spark: SparkSession, folder: str, name: str = ".*") -> DataFrame:
    """Lines of the matching files with ``file``, ``file_no``, ``block`` and ``line_id``.

    Inside a file, ``(block, line_id)`` is the order of the lines: ``block`` is where the split of the
    file begins, and a split is read by one task. So ``block`` serves as the slice of ordered scans.
    """
    meta = F.col("_metadata.file_name")
    return (
        spark.read.text(folder)
        .where(meta.rlike(f"^(?:{name})"))
        .select(
            meta.alias("file"),
            F.col("_metadata.file_block_start").alias(LINE_SLICE),
            F.monotonically_increasing_id().alias("line_id"),
            F.col("value").alias("text"),
        )
        .withColumn("file_no", _file_no(F.col("file"), name))
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_no`` from 1 in each file."""
    return scan(lines, ["file"], LINE_ORDER, {"line_no": row_number()}, LINE_SLICE)


def _split(df: DataFrame, good, text: str = "text") -> tuple[DataFrame, DataFrame]:
    return df.where(good), df.where(~good & (F.trim(text) != "")).select(text)


def run_lines(lines: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Fields of run-time lines of any of the known formats, and the lines that have no seconds."""
    parsed = lines.withColumns(run_fields(F.col(text)))
    return _split(parsed, F.col("seconds").isNotNull(), text)


def run_lines_with_headers(
    lines: DataFrame, order=LINE_ORDER, file=("file",), slice_col: str | None = LINE_SLICE
) -> tuple[DataFrame, DataFrame]:
    """`run_lines` where title and profile lines apply to all following lines of the file."""
    known = carry_headers(lines, HEADERS, order, file, "text", slice_col)
    good, bad = run_lines(known)
    header = F.lit(False)
    for pattern in HEADERS.values():
        header = header | F.col("text").rlike(pattern)
    named = good.withColumn("benchmark", F.coalesce("benchmark", "header_benchmark"))
    return named.drop("header_benchmark"), bad.where(~header)


def equals_seconds(lines: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Whole seconds after the last ``=`` of each line, and the malformed lines."""
    parsed = lines.withColumn("seconds", seconds_after_equals(F.col(text)))
    return _split(parsed, F.col("seconds").isNotNull(), text)


def last_token_values(
    lines: DataFrame, marker: str | None = None, text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Last token of each line as a number, of all lines or of those holding ``marker``."""
    if marker is not None:
        lines = lines.where(F.col(text).contains(marker))
    parsed = lines.withColumn("value", last_token_double(F.col(text)))
    return _split(parsed, F.col("value").isNotNull(), text)


def report_blocks(spark: SparkSession, path: str, zones: dict[str, str] = ZONES) -> DataFrame:
    """Benchmark reports, one row per block; a block goes from its header line to the next one.

    The header parts the records of the reader, so large files are split and empty lines mean nothing.
    """
    blocks = spark.read.option("lineSep", REPORT_HEADER).text(path)
    # what stands before the first header is no block
    return report_fields(blocks.where(F.col("value").rlike(r"^\w+\s*(?:\n|$)")), "value", zones)


def split_reports(texts: DataFrame, text: str = "text", name: str = "block") -> DataFrame:
    """The blocks of texts that hold whole reports, one row each, without their headers' fixed part."""
    # a line break before the text makes the header one literal, and the text is parted once only
    pieces = F.split(F.concat(F.lit("\n"), text), "\n" + REPORT_HEADER)
    others = [c for c in texts.columns if c not in (text, name)]
    return texts.select(*others, F.posexplode(pieces).alias("_at", name)).where("_at > 0").drop("_at")


def report_fields(blocks: DataFrame, text: str = "block", zones: dict[str, str] = ZONES) -> DataFrame:
    """Fields of report blocks. The time is NULL if the block's time zone is not among ``zones``."""
    block = F.col(text)

    def field(label: str, kind: str):
        found = F.regexp_extract(block, rf"(?m){label}:\s*(\S+)\s*$", 1)
        return F.nullif(found, F.lit("")).try_cast(kind)

    when = r"Date & time: \w+ (\w+ +\d+ [\d:]+) (\w+) (\d{4})"
    zone = F.regexp_extract(block, when, 2)
    offset = F.coalesce(*[F.when(zone == name, value) for name, value in zones.items()])
    stamp = F.concat(
        F.regexp_replace(F.regexp_extract(block, when, 1), " +", " "),
        F.lit(" "),
        F.regexp_extract(block, when, 3),
        F.lit(" "),
        offset,
    )
    others = [c for c in blocks.columns if c != text]
    return blocks.select(
        *others,
        F.regexp_extract(block, r"^(\w+)", 1).alias("op"),
        F.try_to_timestamp(stamp, F.lit("MMM d HH:mm:ss yyyy XXX")).alias("run_ts"),
        field("Number of files", "int").alias("n_files"),
        field("Total MBytes processed", "double").alias("total_mb"),
        field("Throughput mb/sec", "double").alias("throughput"),
        field("Average IO rate mb/sec", "double").alias("avg_io"),
        field("IO rate std deviation", "double").alias("io_std"),
        field("Test exec time sec", "double").alias("exec_s"),
    )


def step_table(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``threshold``, ``period`` of a dict literal; threshold -1 is the default."""
    pair = r"(-?\d+)\s*:\s*(\d+)"
    return texts.select(
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all(text, F.lit(pair), 1).alias("a"),
                F.regexp_extract_all(text, F.lit(pair), 2).alias("b"),
            )
        ).alias("p")
    ).select(F.col("p.a").try_cast("int").alias("threshold"), F.col("p.b").try_cast("int").alias("period"))
