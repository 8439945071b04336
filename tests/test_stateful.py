"""Stateful streams against plain Python: however they are cut and wherever they are started again."""

import random
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pacemark.operators import activity
from pacemark.operators.ordered import Slices
from pacemark.session import settings
from pacemark.streaming import live, spans
from pacemark.streaming.run import read_stream, run_to_table

SECOND = 1_000_000
MESSAGES = "cluster bigint, client bigint, us bigint, event_id bigint, verb string, v bigint"


@pytest.fixture()
def state_store(spark):
    with settings(spark, streaming__stateStore__providerClass=live.STATE_STORE):
        yield


def random_messages(seed, n=160):
    """In order of time; one client sends a third of all messages."""
    rng, us, rows = random.Random(seed), 0, []
    for i in range(n):
        us += rng.choice([1, 3, 20, 70]) * SECOND
        client = 1 if rng.random() < 0.33 else rng.randrange(2, 7)
        rows.append((client % 2, client, us, i, rng.choice(["IN", "OUT", "UPDATE", "UPDATE", "UPDATE"]), rng.randrange(90)))
    return rows


def plain_notices(rows, timeout, watermark, restored):
    told = {}
    state = {c: [True, last, rate] for (_, c, rate, last) in restored}
    for cluster, client, us, _, verb, v in rows:
        s = state.setdefault(client, [False, us, 0])
        out = told.setdefault((cluster, client), [])
        if s[0] and us > s[1] + timeout:
            out.append((s[1] + timeout, "expired", s[2]))
            s[0] = False
        if verb == "IN":
            out.append((us, "reset", s[2]) if s[0] else (us, "registered", 0))
            s[0], s[2] = True, 0
        elif s[0] and verb == "OUT":
            out.append((us, "left", s[2]))
            s[0] = False
        elif s[0]:
            s[2] = v
        s[1] = us
    for cluster, client in {(r[0], r[1]) for r in rows} | {(r[0], r[1]) for r in restored}:
        s = state[client]
        if s[0] and (s[1] + timeout) // 1000 < watermark:
            told.setdefault((cluster, client), []).append((s[1] + timeout, "expired", s[2]))
    return Counter((*k, *n) for k, out in told.items() for n in out[1:])


def write_pieces(spark, rows, schema, folder, pieces, at=0):
    """Files in the order of time."""
    size = -(-len(rows) // pieces)
    for i in range(pieces):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema)
        part.withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_notices_over_a_restart(spark, tmp_path, state_store, seed):
    rows = random_messages(seed)
    restored = [(0, 2, 17, -50 * SECOND), (1, 5, 4, -200 * SECOND), (1, 99, 8, -10 * SECOND)]
    known = spark.createDataFrame(restored, "cluster bigint, client bigint, latest bigint, last_us bigint")
    source, folder = f"{tmp_path}/in", f"{tmp_path}/run"

    def work():
        stream = read_stream(spark, source, files_per_batch=1)
        return run_to_table(live.notices(stream, 100 * SECOND, "10 seconds", known), folder)

    half = len(rows) // 2
    write_pieces(spark, rows[:half], MESSAGES, source, 2)
    before = work().count()
    write_pieces(spark, rows[half:], MESSAGES, source, 2)
    got = Counter(tuple(r) for r in work().collect())
    assert got == plain_notices(rows, 100 * SECOND, rows[-1][2] // 1000 - 10_000, restored)
    assert 0 < before < sum(got.values())
    once = run_to_table(live.notices(read_stream(spark, source), 100 * SECOND, "10 seconds", known))
    assert Counter(tuple(r) for r in once.collect()) == got  # in one batch


def test_spans_of_two_streams(spark, tmp_path, state_store):
    rng = random.Random(3)
    starts = [(k, rng.randrange(0, 1000)) for k in range(40)] + [(7, 500), (None, 10)]
    ends = [(rng.randrange(50), rng.randrange(0, 1200), i) for i in range(90)] + [(None, 20, 99)]
    a = spark.createDataFrame(starts, "run bigint, s bigint").select("run", F.timestamp_seconds("s").alias("start_ts"))
    b = spark.createDataFrame(ends, "run bigint, e bigint, n bigint").select("run", F.timestamp_seconds("e").alias("end_ts"), "n")
    a.write.parquet(f"{tmp_path}/a")
    b.write.parquet(f"{tmp_path}/b")
    found = run_to_table(
        spans.run_spans(
            read_stream(spark, f"{tmp_path}/a"), read_stream(spark, f"{tmp_path}/b"), ["run"], "100 seconds", "1500 milliseconds"
        )
    )
    mark = min(max(s for _, s in starts), max(e for _, e, _ in ends)) - 1.5
    pairs = [(k, e - s, n, "paired") for k, s in starts for j, e, n in ends if k is not None and k == j and 0 <= e - s <= 100]
    alone = [
        (k, None, None, "no_end")
        for k, s in starts
        if s + 100 < mark and not any(j == k and k is not None and 0 <= e - s <= 100 for j, e, _ in ends)
    ]
    lone = [
        (k, None, n, "no_start")
        for k, e, n in ends
        if e < mark and not any(j == k and k is not None and 0 <= e - s <= 100 for j, s in starts)
    ]
    got = Counter((r.run, r.seconds, r.n, r.status) for r in found.collect())
    assert {x[3] for x in got} == {"paired", "no_end", "no_start"}
    # rows with a null key match nothing; an outer join of streams leaves them out or brings them out late
    assert Counter({x: c for x, c in got.items() if x[0] is not None}) == Counter(
        x for x in pairs + alone + lone if x[0] is not None
    )


def plain_sessions(rows, gap):
    out, last = [], {}
    for client, us in sorted(rows):
        if client in last and us - last[client][1] <= gap:
            last[client][1] = us
            last[client][2] += 1
        else:
            last[client] = [us, us, 1]
            out.append((client, last[client]))
    return Counter((c, *s) for c, s in out)


def spans_of(df):
    rows = df.select("client", F.unix_micros("start_ts"), F.unix_micros("end_ts"), "n").collect()
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("rows_per_slice", [10, 100_000])
def test_sessions_of_a_busy_client(spark, rows_per_slice):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(2, 9), rng.randrange(20_000) * SECOND) for _ in range(400)]
    df = spark.createDataFrame([(c, us, i) for i, (c, us) in enumerate(rows)], "client bigint, us bigint, event_id bigint")
    sliced = Slices.plan(df, ("us", "event_id"), rows_per_slice).assign(df).withColumn("ts", F.timestamp_micros("us"))
    want = plain_sessions(rows, 300 * SECOND)
    assert spans_of(activity.sessions(sliced, ["client"], "ts", "300 seconds")) == want
    assert spans_of(activity.sessions(sliced, ["client"], "ts", "300 seconds", slice_col=None)) == want
    none = activity.sessions(sliced.withColumn("ts", F.lit(None).cast("timestamp")), ["client"], "ts", "300 seconds")
    assert none.count() == 0


def test_sessions_of_a_stream_in_pieces(spark, tmp_path, state_store):
    rows = [r for r in random_messages(9, 200)]
    write_pieces(spark, rows, MESSAGES, f"{tmp_path}/in", 4)
    stream = read_stream(spark, f"{tmp_path}/in", files_per_batch=1)
    local = {"streaming__sessionWindow__merge__sessions__in__local__partition": "true"}
    with settings(spark, **local):
        got = spans_of(run_to_table(activity.session_stream(stream, ["client"], "ts", "65 seconds", "500 milliseconds")))
    mark = rows[-1][2] - SECOND // 2
    want = plain_sessions([(r[1], r[2]) for r in rows], 65 * SECOND)
    assert got == Counter({s: n for s, n in want.items() if s[2] + 65 * SECOND <= mark})


class Calls:
    """Stands for a state and its handle; notes each call, a round trip to the state store."""

    def __init__(self):
        self.made, self.kept = [], None

    def getValueState(self, *_):
        return self

    def get(self):
        self.made.append("get")
        return self.kept

    def update(self, value):
        self.made.append("update")
        self.kept = value

    def registerTimer(self, at):
        self.made.append(("wake", at))

    def deleteTimer(self, at):
        self.made.append(("drop", at))


def test_few_state_calls_per_client_and_batch():
    clients, calls = live.LiveClients(100 * SECOND), Calls()
    clients.init(calls)
    sent = [Row(us=us * SECOND, event_id=i, verb=verb, v=v) for i, (us, verb, v) in enumerate([(9, "UPDATE", 4), (1, "IN", 0)])]
    assert list(clients.handleInputRows((0, 1), iter(sent), None)) == []  # the first notice is not sent on
    assert calls.made == ["get", "update", ("wake", 109_000)]
    calls.made.clear()
    again = [Row(us=9 * SECOND, event_id=7, verb="IN", v=0)]
    assert [tuple(r) for r in clients.handleInputRows((0, 1), iter(again), None)] == [(0, 1, 9 * SECOND, "reset", 4)]
    assert calls.made == ["get", "update"]  # the timer stays


def test_state_settings_end_with_the_stream(spark):
    name = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    with settings(spark, **live.STATE_SETTINGS):
        assert spark.conf.get(name) == "false"
    assert spark.conf.get(name, None) is None
