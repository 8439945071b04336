import random

import pytest
from pyspark.sql import functions as F

from models import Cluster
from pacemark.sources import sinks
from pacemark.sources.telemetry import MESSAGE, message_stream, messages
from pacemark.streaming.rollup import rate_windows
from pacemark.streaming.supervisor import CLIENTS, CLUSTERS, RINGS, Supervisor, skip_first_batches


def make_messages(seed, n=1500, clusters=3, clients=6):
    rng, rows, t = random.Random(seed), [], 1_700_000_000_000_000
    for i in range(n):
        t += rng.randint(0, 3_000_000)
        cluster = 0 if rng.random() < 0.6 else rng.randrange(clusters)
        client = cluster * 100 + rng.randrange(clients)
        kind = rng.random()
        if kind < 0.12:
            msg = "IN"
        elif kind < 0.18:
            msg = "OUT"
        elif kind < 0.6:
            msg = f"UPDATE:{rng.randint(0, 120)}"
        elif kind < 0.75:
            msg = f"UPDATE-CC:{rng.randint(1, 90_000)}"
        elif kind < 0.9:
            msg = f"UPDATE-MTBF:{t / 1e6:.1f}"
        elif kind < 0.94:
            msg = f"UPDATE-RAM:{rng.choice(['41.5', 'x'])}"
        else:
            msg = rng.choice(["UPDATE", "HELLO", "UPDATE:zz"])
        rows.append((f"c{cluster}", f"host{client}:70{client}", t // 1_000_000, t, i, msg))
    return rows


def model(rows, **kw):
    state = {}
    for cluster, client, _, us, i, msg in rows:
        verb, *rest = msg.split(":")
        if verb != msg and verb == "UPDATE" and not rest[0].isdigit():
            continue
        if msg in ("UPDATE", "HELLO"):
            continue
        state.setdefault(cluster, Cluster(**kw)).message((us, i), client, verb, rest[0] if rest else None)
    return state


def write_files(spark, rows, folder, parts):
    schema = MESSAGE.replace("ts timestamp", "ts bigint")
    size = -(-len(rows) // parts)
    for p in range(parts):
        df = spark.createDataFrame(rows[p * size : (p + 1) * size], schema)
        df.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(folder)


def found(spark, sup, name, *columns):
    rows = sup.read(spark, name).select("cluster", *columns).collect()
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("parts", [3])
def test_stream_equals_model(spark, tmp_path, parts):
    rows = make_messages(parts)
    write_files(spark, rows, str(tmp_path / "in"), parts)
    sup = Supervisor(str(tmp_path / "out"), history=7)
    stream = message_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    sup.run(stream, str(tmp_path / "ck")).awaitTermination()
    want = model(rows, n=7)
    totals = found(spark, sup, "totals", "us", "event_id", "total")
    assert totals == {k: sorted(c.totals) for k, c in want.items()}
    assert found(spark, sup, "announced", "us", "event_id", "period") == {
        k: sorted(c.announced) for k, c in want.items()
    }
    assert found(spark, sup, "unregistered", "us", "event_id") == {
        k: sorted(c.unregistered) for k, c in want.items() if c.unregistered
    }
    bad = sum(1 for r in rows if r[5] in ("UPDATE", "HELLO", "UPDATE:zz"))
    assert sup.read(spark, "rejected").count() == bad
    assert sup.read(spark, "late").count() == 0


def test_repeated_batch_and_late_rows(spark, tmp_path):
    rows = make_messages(9, 300)
    write_files(spark, rows, str(tmp_path / "in"), 1)
    df = messages(spark, str(tmp_path / "in"))
    sup = Supervisor(str(tmp_path / "out"), history=7)
    middle = rows[150][3]
    sup.process(df.where(F.col("us") < middle), 0)
    sup.process(df.where(F.col("us") >= middle), 1)
    first = found(spark, sup, "announced", "us", "event_id", "period")
    sup.process(df.where(F.col("us") >= middle), 1)  # the batch comes again
    assert found(spark, sup, "announced", "us", "event_id", "period") == first
    assert first == {k: sorted(c.announced) for k, c in model(rows, n=7).items()}
    sup.process(df.where(F.col("us") < middle), 2)  # old rows are late
    assert sup.read(spark, "late").count() == sum(1 for r in rows if r[3] < middle)
    assert found(spark, sup, "announced", "us", "event_id", "period") == first


def test_seeded_state(spark, tmp_path):
    sup = Supervisor(str(tmp_path / "out"), history=3)
    sup.seed(
        spark.createDataFrame([("0", "1", 70)], CLIENTS),
        spark.createDataFrame(
            [("0", "checkpoint", s, v, 1) for s, v in enumerate([3000, 4000, 2000])]
            + [("0", "mtbf", 0, 100, 0)],
            RINGS,
        ),
        spark.createDataFrame([("0", 36, 1000, 0, 0, None, None, None)], CLUSTERS),
    )
    rows = [("0", "1", 2000, 2_000_000_000, 1, "UPDATE:75"), ("0", "1", 2001, 2_001_000_000, 2, "UPDATE-MTBF:1300")]
    df = spark.createDataFrame(rows, MESSAGE.replace("ts timestamp", "ts bigint")).withColumn(
        "ts", F.timestamp_seconds("ts")
    )
    sup.process(df, 0)
    # mean cost 3 s, mean gap (100 + 300) / 2: floor(sqrt(2 * 3 * 200)) = 34, inside the dead-band of 36
    assert found(spark, sup, "totals", "event_id", "total") == {"0": [(1, 75)]}
    assert sup.read(spark, "announced").count() == 0
    ring = sinks.read_version(spark, sup.table("rings"), RINGS).where("series = 'mtbf'").collect()
    assert sorted((r.slot, r.value, r.pointer) for r in ring) == [(0, 100, 1), (1, 300, 1)]


def test_rate_windows(spark, tmp_path):
    rows = [("0", "1", t, i, i + 1, m) for i, (t, m) in enumerate(
        [(0, "UPDATE:10"), (30, "UPDATE:20"), (700, "UPDATE:5"), (5000, "UPDATE:1")])]
    write_files(spark, rows, str(tmp_path / "in"), 1)
    out = rate_windows(message_stream(spark, str(tmp_path / "in")))
    q = (
        out.writeStream.format("memory").queryName("rates").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = spark.table("rates").select(F.unix_seconds("window_start"), "n", "sum_rate", "max_rate")
    assert sorted(map(tuple, got.collect())) == [(0, 2, 30, 20), (600, 1, 5, 5)]


def test_skip_first_and_upsert_streams(spark, tmp_path):
    schema = "path string, value string, us bigint, event_id bigint"
    one = spark.createDataFrame([("/a/", "1", 1, 1), ("/a/", "2", 2, 2), ("/b/", "1", 3, 3)], schema)
    two = spark.createDataFrame([("/a/", "3", 4, 4), ("/c/", "1", 5, 5)], schema)
    skip = skip_first_batches(str(tmp_path / "skip"), ["path"], "path string")
    keep = sinks.upsert_batches(str(tmp_path / "kv"))
    for i, df in enumerate([one, two, two]):  # the second batch is repeated
        skip(df, min(i, 1))
        keep(df, min(i, 1))
    notices = spark.read.parquet(str(tmp_path / "skip/notices"))
    assert sorted(r.event_id for r in notices.collect()) == [2, 4]
    state = sinks.read_version(spark, str(tmp_path / "kv"), sinks.SHAPE)
    assert sorted(map(tuple, state.collect())) == [("/a/", "3"), ("/b/", "1"), ("/c/", "1")]
    write = sinks.append_batches(str(tmp_path / "log"))
    write(one, 0)
    write(one, 0)
    write(two, 1)
    sinks.append(one, str(tmp_path / "plain"))
    sinks.append(two, str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 5


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    rows = make_messages(4, 400)
    write_files(spark, rows[:200], str(tmp_path / "a"), 1)
    write_files(spark, rows[200:], str(tmp_path / "b"), 1)
    sup = Supervisor(str(tmp_path / "out"), history=7)
    for part in ("a", "b"):  # two streams, each with a batch 0
        sup.run(message_stream(spark, str(tmp_path / part)), str(tmp_path / f"ck-{part}")).awaitTermination()
    want = model(rows, n=7)
    assert found(spark, sup, "totals", "us", "event_id", "total") == {k: sorted(c.totals) for k, c in want.items()}
    assert found(spark, sup, "announced", "us", "event_id", "period") == {k: sorted(c.announced) for k, c in want.items()}


def test_versions_and_older_batches(spark, tmp_path):
    path = str(tmp_path / "kv")
    one = spark.createDataFrame([("/a/", "1")], "path string, value string")
    for stream, batch in [("x", 0), ("x", 1), ("y", 0), ("y", 1), ("y", 2), ("y", 2)]:
        before = sinks.read_version(spark, path, sinks.SHAPE, stream, batch)
        sinks.write_version(before.unionByName(one), path, batch, stream)
    assert sinks.read_version(spark, path, sinks.SHAPE).count() == 5  # the repeated batch counts once
    assert len(sinks._versions(spark, path)) == 3
    with pytest.raises(ValueError):
        sinks.write_version(one, path, 1, "y")


@pytest.mark.parametrize("cuts", [[], [3, 7]])
def test_starts_and_stops_in_streams(spark, tmp_path, cuts):
    """The same announcements and rings whether lifecycle messages come in one batch or in several."""
    steps = [
        ("START", 1000), ("UPDATE-CC", 4000), ("STOP", 1100), ("START", 1200), ("UPDATE-MTBF", 1250),
        ("UPDATE-MTBF", 1400), ("STOP", 1430), ("STOP", 1440), ("UPDATE-MTBF", 1445), ("START", 1500), ("UPDATE-MTBF", 1550),
    ]
    rows = [("c", "h", i, i * 1_000_000, i, f"{v}:{t}") for i, (v, t) in enumerate(steps)]
    df = spark.createDataFrame(rows, MESSAGE.replace("ts timestamp", "ts bigint")).withColumn("ts", F.timestamp_seconds("ts"))
    sup = Supervisor(str(tmp_path / "out"), history=3, carry=True)
    for batch, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        sup.process(df.where(F.col("event_id").between(a, b - 1)), batch)
    ring = sinks.read_version(spark, sup.table("rings"), RINGS).where("series = 'mtbf'").collect()
    # 50 + 100 stored at the first STOP; 150; 50 + 40 stored at the second of two STOPs
    assert sorted((r.slot, r.value, r.pointer) for r in ring) == [(0, 150, 2), (1, 150, 2), (2, 90, 2)]
    state = sinks.read_version(spark, sup.table("clusters"), CLUSTERS).first()
    assert (state.failed_at, state.elapsed, state.running) == (1550, 0, True)
    assert [r.period for r in sup.read(spark, "announced").orderBy("us").collect()] == [34]


def test_slots_go_on_after_a_restore(spark):
    from pacemark.operators import history

    seeds = spark.createDataFrame([("c", "s", i, v, 1) for i, v in [(0, 40), (1, 50), (2, 30)]], "cluster string, series string, slot int, value bigint, pointer int")
    live = spark.createDataFrame([("c", "s", 10, 1, 60, 0), ("c", "s", 11, 2, 70, 0), ("d", "s", 11, 3, 5, 0)], "cluster string, series string, us bigint, event_id bigint, value bigint, slice bigint")
    out = history.restore(seeds, live, 3)
    slots = {(r.cluster, r.value): r.seq % 3 for r in out.collect()}
    assert slots == {("c", 30): 2, ("c", 40): 0, ("c", 50): 1, ("c", 60): 2, ("c", 70): 0, ("d", 5): 0}
    ring = history.ring_current(out, 3)
    assert {(r.cluster, r.value): r.slot for r in ring.collect()} == {("c", 50): 1, ("c", 60): 2, ("c", 70): 0, ("d", 5): 0}
