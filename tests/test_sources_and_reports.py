"""Log source, recursive flattening, sketched medians, subtotals, observed writes, streams without repeats."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pacemark.operators import kvrecursive, kvtree, quantiles, runs, workloads
from pacemark.session import settings
from pacemark.sources import logsource, sinks
from pacemark.streaming import live
from pacemark.streaming.run import read_stream, run_to_table

LOGS = {
    "nn1.log": b"first\nsecond \xc3\xa9\n\nlast without end",
    "nn2.log": b"",
    "sub/nn10.log": b"ten\n",
    "nn3.log": b"bad \xff byte\r\n",
    "other.txt": b"not a log\n",
}
WANT = [
    ("nn1.log", 1, 1, "first"), ("nn1.log", 1, 2, "second é"), ("nn1.log", 1, 3, ""), ("nn1.log", 1, 4, "last without end"),
    ("sub/nn10.log", 10, 1, "ten"), ("nn3.log", 3, 1, "bad � byte\r"),
]


def write_logs(folder, names):
    for name in names:
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(LOGS[name])


def reader(spark, folder):
    logsource.register(spark)
    return spark.read.format(logsource.FORMAT).option("path", str(folder)).option("name", r"(?:sub/)?nn([0-9]+)\.log")


def test_log_source(spark, tmp_path):
    write_logs(tmp_path, LOGS)
    lines = reader(spark, tmp_path).load()
    assert Counter(tuple(r) for r in lines.collect()) == Counter(WANT)
    assert lines.rdd.getNumPartitions() == 4  # one per file
    late = lines.where("file_no >= 3 and file_no in (3, 10, 11) and text like 't%'")
    assert [tuple(r) for r in late.collect()] == [WANT[4]]
    assert reader(spark, f"file://{tmp_path}").load().where("file_no = 1").count() == 4
    assert reader(spark, tmp_path / "none").load().count() == 0


def test_pushed_conditions_leave_files_unopened(tmp_path):
    write_logs(tmp_path, LOGS)
    r = logsource.LogReader(str(tmp_path), r"(?:sub/)?nn([0-9]+)\.log")
    kept = list(r.pushFilters([logsource.GreaterThan(("file_no",), 1), logsource.EqualTo(("text",), "x")]))
    assert [f.attribute for f in kept] == [("text",)]
    assert [f.number for f in r.partitions()] == [2, 3, 10]


def test_lines_across_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(logsource, "BATCH_BYTES", 7)
    lines = [f"line {i} " + "x" * (i % 30) for i in range(200)]
    (tmp_path / "nn4.log").write_text("\n".join(lines))
    [file] = logsource.numbered_files(str(tmp_path), r"nn([0-9]+)\.log")
    rows = [r for b in logsource.lines_of(file) for r in b.to_pylist()]
    assert [r["text"] for r in rows] == lines and [r["line_no"] for r in rows] == list(range(1, 201))


def test_log_source_as_a_stream(spark, tmp_path):
    logsource.register(spark)
    folder = tmp_path / "logs"
    stream = (
        spark.readStream.format(logsource.FORMAT).option("path", str(folder)).option("name", r"(?:sub/)?nn([0-9]+)\.log")
    )
    write_logs(folder, ["nn1.log", "nn2.log"])
    assert run_to_table(stream.load(), f"{tmp_path}/run").count() == 4
    write_logs(folder, ["nn3.log", "sub/nn10.log"])  # read on from the last number
    assert Counter(tuple(r) for r in run_to_table(stream.load(), f"{tmp_path}/run").collect()) == Counter(WANT)


def test_recursive_flattening_equals_unrolled(spark):
    rng, rows = random.Random(1), {}
    for _ in range(150):
        path = "/" + "".join(rng.choice(["a", "b", "c d", 'e"']) + "/" for _ in range(rng.randrange(0, 7)))
        rows[rng.choice([1, 2, None]), path] = rng.choice(["", "v", "{[", None])
    nodes = spark.createDataFrame([(s, p, v) for (s, p), v in rows.items()], "snapshot bigint, path string, value string")
    texts = kvtree.nest(nodes)
    more = spark.createDataFrame([(7, "no json {"), (8, None), (9, "[1, 2]"), (10, '{"/": ["x", "/", {}]}')], texts.schema)
    documents = texts.unionByName(more)
    want = Counter(tuple(r) for r in kvtree.flatten(documents.where("snapshot is distinct from 9")).collect())
    assert Counter(tuple(r) for r in kvrecursive.flatten(documents).collect()) == want and want


def test_sketched_median_of_a_large_group(spark):
    rng = random.Random(6)
    rows = [(1 if rng.random() < 0.6 else 2, i % 20, int(rng.gauss(500, 100))) for i in range(30_000)]
    rows += [(3, 1, 5), (3, 2, 5), (4, 1, None)]
    df = spark.createDataFrame(rows, "key bigint, day int, value int")
    daily = quantiles.sketches(df, ["key", "day"], "value")
    got = {r.key: (r.n, r.grouped_median) for r in quantiles.grouped_median(quantiles.merged(daily, ["key"])).collect()}
    assert got.keys() == {1, 2, 3}
    for key in (1, 2):
        values = sorted(v for k, _, v in rows if k == key)
        assert got[key][0] == len(values)
        share = sum(v <= got[key][1] for v in values) / len(values)
        assert abs(share - 0.5) < 0.02
        assert abs(got[key][1] - statistics.median_grouped(values)) < 5
    assert got[3] == (2, 5.0)


def test_sketched_median_of_small_groups(spark):
    """Values far apart, so that the lower of two middle rows is a wrong median."""
    rng = random.Random(7)
    groups = {n: [rng.randint(1, 1_000) for _ in range(n)] for n in range(1, 41)}
    groups |= {50: [1, 2, 10, 20], 51: [1, 1, 9, 9], 52: [3, 3, 3, 8, 8, 8]}
    rows = [(key, i % 3, v) for key, values in groups.items() for i, v in enumerate(values)]
    daily = quantiles.sketches(spark.createDataFrame(rows, "key bigint, day int, value int"), ["key", "day"], "value")
    got = {r.key: (r.n, r.grouped_median) for r in quantiles.grouped_median(quantiles.merged(daily, ["key"])).collect()}
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        assert got[key] == (len(values), pytest.approx(statistics.median_grouped(values), abs=0.06))


def test_subtotals(spark):
    rows = [("x", 1, "AF", 2.0), ("x", 1, "DF", 4.0), ("x", 2, "AF", 6.0), (None, 1, "DF", 1.0), ("y", None, "AF", None)]
    df = spark.createDataFrame(rows, "benchmark string, rep int, phase string, seconds double")
    got = {(r.benchmark, r.rep, r.grouping): (r.n, r.mean_af, r.mean_df, r.ratio) for r in
           runs.phase_subtotals(df, ["benchmark", "rep"], "seconds").collect()}
    assert got[None, None, 3] == (4, 4.0, 2.5, 0.625)
    assert got["x", None, 1] == (3, 4.0, 4.0, 1.0) and got["x", 1, 0] == (2, 2.0, 4.0, 2.0)
    assert got[None, None, 1] == (1, None, 1.0, None)  # the group without a benchmark, not the total
    assert got[None, 1, 2] == (3, 2.0, 2.5, 1.25) and got["y", None, 0] == (0, None, None, None)


def test_observed_write(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("part"), F.concat(F.lit("é"), "id").alias("line"))
    rows = {r.part: r for r in workloads.observed_write(df, f"{tmp_path}/t", "part").collect()}
    size = sum(len(f"é{i}\n".encode()) for i in range(100))
    assert {r.n_rows for r in rows.values()} == {100} and {r.n_bytes for r in rows.values()} == {size}
    assert sum(r.part_bytes for r in rows.values()) == size and rows[0].part_rows == 34 and rows[0].n_files == 1


@pytest.mark.parametrize("files", [1, None])
def test_repeats_over_batches(spark, tmp_path, files):
    first = [(1, i, i) for i in range(0, 40, 2)]
    again = first[-5:] + [(2, 38, 39)] + [(1, 100, 60)]
    for rows in (first, again, again):
        df = spark.createDataFrame(rows, "cluster bigint, event_id bigint, s bigint")
        df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with settings(spark, streaming__stateStore__providerClass=live.STATE_STORE):
        kept = run_to_table(sinks.without_repeats(read_stream(spark, f"{tmp_path}/in", files), ["cluster", "event_id"]))
    got = Counter((r.cluster, r.event_id) for r in kept.collect())
    assert got == Counter({(1, i): 1 for i in range(0, 40, 2)} | {(2, 38): 1, (1, 100): 1})
