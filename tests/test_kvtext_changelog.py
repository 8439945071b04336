"""Nesting in pieces and the log-structured table of latest values."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pacemark.operators import kvtext, kvtree
from pacemark.session import settings
from pacemark.sources.changelog import ChangeLog

NODES = "snapshot bigint, path string, value string"


def random_nodes(seed, n=120):
    rng, rows = random.Random(seed), {}
    names = ["a", "b", "a b", "a-b", "a.b", "é", "z\"q", "a\\", "\U0001F600", "0", "~", "B"]
    for _ in range(n):
        path = "/" + "".join(rng.choice(names) + "/" for _ in range(rng.randrange(0, 5)))
        rows[rng.choice([1, 2, None]), path] = rng.choice(["", "v", None, "x" * rng.randrange(300), "line\nbreak", "ü\"\t"])
    return [(s, p, v) for (s, p), v in rows.items()]


def joined(pieces, size):
    """Snapshots from their pieces; all but the last are of full size."""
    texts = {}
    for r in sorted(pieces.collect(), key=lambda r: r.piece):
        texts.setdefault(r.snapshot, []).append(r.text)
    for parts in texts.values():
        assert all(len(p) == size for p in parts[:-1]) and 0 < len(parts[-1]) <= size
    return {s: "".join(p) for s, p in texts.items()}


@pytest.mark.parametrize("size", [7, 64, 10_000])
def test_pieces_make_up_the_nested_document(spark, size):
    nodes = spark.createDataFrame(random_nodes(size), NODES).repartition(3)
    want = {r.snapshot: r.doc for r in kvtree.nest(nodes).collect()}
    assert joined(kvtext.nest_pieces(nodes, size=size), size) == want


def test_no_task_holds_a_large_snapshot(spark):
    rows = spark.range(20_000).select(
        F.lit(1).cast("bigint").alias("snapshot"), F.format_string("/one/%06d/", "id").alias("path"), F.lit("v" * 40).alias("value")
    )
    with settings(spark, adaptive__coalescePartitions__enabled="false"):
        pieces = kvtext.nest_pieces(rows, size=8_192)
        sizes = pieces.select(F.length("text").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert max(r.n for r in sizes) == 8_192 and len({r.p for r in sizes}) > 1
    assert sum(r.n for r in sizes) == len(kvtree.nest(rows).first().doc)
    assert kvtext.nest_pieces(rows.where("false")).count() == 0


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.startswith("part-"))


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "path string, value string, us bigint, event_id bigint")


def state_of(log, spark):
    return {r.path: r.value for r in log.read(spark).collect()}


def test_latest_values_over_batches(spark, tmp_path):
    rng, want = random.Random(2), {}
    log = ChangeLog(str(tmp_path / "t"), buckets=4)
    assert log.compact(spark) == [] and state_of(log, spark) == {}
    for batch in range(6):
        rows = [(rng.choice([f"/{i}/" for i in range(30)] + [None]), str(rng.random()), rng.randrange(5), i) for i in range(40)]
        rows = [] if batch == 3 else rows
        log.write(batch_of(spark, rows), batch, "s")
        for path, value, _, _ in sorted(rows, key=lambda r: (r[2], r[3])):
            want[path] = value
        if batch % 2:
            log.compact(spark)
        assert state_of(log, spark) == want
        log.write(batch_of(spark, rows), batch, "s")  # a repeated batch replaces itself
        assert state_of(log, spark) == want
    log.vacuum(spark)
    assert state_of(log, spark) == want
    with pytest.raises(ValueError):
        log.write(batch_of(spark, []), 2, "s")
    number = log.write(batch_of(spark, [("/0/", "new", 0, 0)]), 0, "another stream")
    assert number == 6 and state_of(log, spark) == {**want, "/0/": "new"}
    log.compact(spark, ratio=0.0)
    log.vacuum(spark)
    assert state_of(log, spark) == {**want, "/0/": "new"}


def test_bytes_written_follow_the_changes(spark, tmp_path):
    log = ChangeLog(str(tmp_path / "t"), buckets=8, ratio=0.5)
    rows = spark.range(40_000).select(
        F.format_string("/%d/", "id").alias("path"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("value"),
        F.lit(0).cast("bigint").alias("us"), F.col("id").alias("event_id"),
    )
    log.write(rows, 0, "s")
    assert len(log.compact(spark)) == 8
    whole = folder_bytes(tmp_path / "t/base")
    before = folder_bytes(tmp_path)
    for batch in range(1, 4):
        log.write(rows.where(F.col("event_id") % 400 == batch), batch, "s")
        assert log.compact(spark) == []  # far from half of any base
    assert 0 < folder_bytes(tmp_path) - before < 0.05 * whole
    one = rows.where(log.bucket() == 3)  # changes of one bucket only
    log.write(one, 4, "s")
    assert log.compact(spark) == [3]
    assert folder_bytes(tmp_path / "t/base") - whole < 0.2 * whole
    assert log.read(spark).count() == 40_000


def test_a_stream_into_the_log(spark, tmp_path):
    log = ChangeLog(str(tmp_path / "t"), buckets=2)
    for i in range(3):
        batch_of(spark, [("/a/", f"a{i}", i, i), (f"/{i}/", "x", i, i)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, value string, us bigint, event_id bigint").option("maxFilesPerTrigger", 1)
    query = (
        stream.parquet(f"{tmp_path}/in").writeStream.foreachBatch(log.batches())
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = state_of(log, spark)
    assert got.keys() == {"/a/", "/0/", "/1/", "/2/"} and got["/a/"].startswith("a")
