import random

import pytest
from pyspark.sql import functions as F

from models import step, time_between_failures
from pacemark.functions import periods, text
from pacemark.functions.stats import floor_div, margin95, overhead_percent
from pacemark.operators import history, kvtree, lists, logs, policy, runs, telemetry, workloads
from pacemark.operators.ordered import Slices

ORDER = ["us", "event_id"]


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def agents(spark, *steps):
    rows = [(0, c, i, i, verb, v, i // 2) for i, (verb, c, v) in enumerate(steps)]
    return spark.createDataFrame(
        rows, "cluster int, client string, us bigint, event_id bigint, verb string, v bigint, slice bigint"
    )


def test_parse_messages(spark):
    texts = ["IN", "OUT", "UPDATE", "UPDATE:12:9", "UPDATE:x", "UPDATE-RAM:x", "UPDATE-CC:5", "HELLO", "IN:1",
             "UPDATE-MTBF:z", "UPDATE-CC"]
    df = spark.createDataFrame([(t,) for t in texts], "msg string")
    got = values(telemetry.parse_messages(df), "verb", "payload", "status")
    assert got == [
        ("IN", None, "ok"),
        ("OUT", None, "ok"),
        ("UPDATE", None, "message_error"),
        ("UPDATE", "12", "ok"),
        ("UPDATE", "x", "message_error"),
        ("UPDATE-RAM", "x", "ok"),
        ("UPDATE-CC", "5", "ok"),
        (None, None, "unknown"),
        (None, None, "unknown"),
        ("UPDATE-MTBF", "z", "message_error"),
        ("UPDATE-CC", None, "message_error"),
    ]
    assert one(spark, telemetry.ram_percent(F.lit("x"))) == 0.0


def test_roster_totals(spark):
    df = agents(
        spark, ("UPDATE", "z", 5), ("IN", "a", None), ("UPDATE", "a", 70), ("IN", "b", None),
        ("UPDATE", "b", 20), ("IN", "a", None), ("OUT", "b", None), ("OUT", "b", None), ("UPDATE", "b", 9),
    )
    got = values(telemetry.io_total(df).orderBy("us"), "accepted", "total")
    accepted = [False, True, True, True, True, True, True, False, False]
    assert got == list(zip(accepted, [0, 0, 70, 70, 90, 20, 0, 0, 0]))
    assert [r[0] for r in values(telemetry.roster(df).orderBy("us"), "accepted")] == accepted
    assert values(telemetry.client_latest(df), "client", "latest") == [("a", 0)]


def test_steps(spark):
    totals = [0, 60, 61, 80, 81, 500, 501, -5]
    df = spark.createDataFrame([(t,) for t in totals], "total bigint")
    want = [10, 10, 36, 36, 60, 500, 500, 500]
    assert [r[0] for r in values(policy.io_period(df), "period")] == want == [step(t) for t in totals]
    table = spark.createDataFrame(periods.IO_STEPS, "threshold int, period int")
    rows = df.select("total", F.monotonically_increasing_id().alias("us")).withColumn("event_id", F.col("us"))
    merged = policy.step_period_join(rows, table, periods.IO_STEP_DEFAULT)
    assert dict(values(merged, "total", "period")) == dict(zip(totals, want))


def test_counter_rate(spark):
    df = spark.createDataFrame(
        [(0, 1, i, i, t, c, i // 2) for i, (t, c) in enumerate([(0, 10), (2, 15), (2, 20), (4, 17), (6, 20)])],
        "cluster int, client int, us bigint, event_id bigint, t bigint, counter bigint, slice bigint",
    )
    got = telemetry.counter_rate(df).orderBy("us")
    assert [r[0] for r in values(got, "rate")] == [None, 2, None, -2, 1]
    reset = telemetry.counter_rate(df, reset_is_null=True).orderBy("us")
    assert [r[0] for r in values(reset, "rate")] == [None, 2, None, None, 1]
    assert telemetry.rate_filter(got, 2).count() == 1
    for a, b in [(-7, 2), (7, -2), (-7, -2), (7, 2), (6, -2), (0, -3)]:
        assert one(spark, floor_div(F.lit(a), F.lit(b))) == a // b
    assert one(spark, floor_div(F.lit(1), F.lit(0))) is None


def test_periods(spark):
    c, m = F.lit(50.0), F.lit(7200.0)
    assert one(spark, periods.young(c, m)) == pytest.approx(848.528137)
    assert one(spark, periods.daly_first(c, m, F.lit(100.0))) == pytest.approx(730_000**0.5)
    assert one(spark, periods.daly_high(F.lit(20000.0), m)) == 7200
    assert one(spark, periods.daly_high_compat(c, m).cast("int")) == 798
    r = 50 / 14400
    assert one(spark, periods.daly_high(c, m)) == pytest.approx(848.528137 * (1 + r**0.5 / 3 + r / 9) - 50)
    assert one(spark, periods.young(F.lit(-1.0), m)) is None
    assert one(spark, periods.young(F.lit(-1.0), m, compat=True)) == -1
    assert one(spark, periods.daly_high(F.lit(-1.0), m, compat=True)) == -1
    cost = F.lit(50_000)
    assert one(spark, periods.period_by_policy(F.lit(1), cost, m)) == 848
    assert one(spark, periods.period_by_policy(F.lit(2), cost, m, compat=True)) == 798
    assert one(spark, periods.valid_period(F.lit(3))) == 10
    assert one(spark, periods.valid_period(F.lit(-3))) is None


def lifecycle(spark, *steps):
    rows = [(0, i, i, t, verb, i // 2) for i, (verb, t) in enumerate(steps)]
    return spark.createDataFrame(
        rows, "cluster int, us bigint, event_id bigint, t bigint, verb string, slice bigint"
    )


def test_carry_by_hand(spark):
    a = lifecycle(spark, ("START", 0), ("STOP", 100), ("START", 200), ("FAIL", 250))
    assert values(history.tbf_carry_last(a), "value") == [(150,)]
    b = lifecycle(
        spark, ("START", 0), ("STOP", 100), ("START", 200), ("STOP", 230), ("START", 300), ("FAIL", 310)
    )
    assert values(history.tbf_carry_last(b), "value") == [(40,)]
    assert values(history.tbf_carry_accumulate(b), "value") == [(140,)]
    c = lifecycle(spark, ("START", 10), ("STOP", 10), ("START", 20), ("FAIL", 30))
    assert values(history.tbf_carry_last(c), "value") == [(10,)]


@pytest.mark.parametrize("seed", range(2))
def test_carry_equals_loop(spark, seed):
    rng, rows, t = random.Random(seed), [], 0
    for i in range(700):
        t += rng.randint(0, 3)
        rows.append((0 if rng.random() < 0.7 else 1, i, i, t, rng.choice(["START", "STOP", "FAIL"])))
    df = spark.createDataFrame(rows, "cluster int, us bigint, event_id bigint, t bigint, verb string")
    df = Slices.plan(df, ORDER, min_slices=10).assign(df)
    for carry, operator in (("last", history.tbf_carry_last), ("all", history.tbf_carry_accumulate)):
        want = set()
        for k in (0, 1):
            mine = [r for r in rows if r[0] == k]
            want |= {(mine[i][2], v) for i, v in time_between_failures([r[3:] for r in mine], carry)}
        assert set(values(operator(df), "event_id", "value")) == want


def test_ring(spark):
    df = spark.createDataFrame(
        [("c", "s", i, i, v, i // 2) for i, v in enumerate([1, 2, 3, 4, 5])],
        "cluster string, series string, us bigint, event_id bigint, value bigint, slice bigint",
    )
    slots = history.ring_slots(df, 3)
    assert [r[0] for r in values(slots.orderBy("us"), "slot")] == [0, 1, 2, 0, 1]
    means = history.history_avg(slots, 3).orderBy("us")
    assert [r[0] for r in values(means, "avg_value")] == [1, 1.5, 2, 3, 4]
    ring = history.ring_current(df, 3)
    assert sorted(values(ring, "slot", "value")) == [(0, 4), (1, 5), (2, 3)]
    assert one(spark, history.whole(F.lit("-2.9"))) == -2
    assert one(spark, history.restored_period(F.lit("x"))) == 0


def test_value_at(spark):
    seen = spark.createDataFrame(
        [(0, 10, 1, 5.0, 0), (0, 20, 2, 7.0, 1)], "cluster int, us bigint, event_id bigint, a double, slice int"
    )
    asked = spark.createDataFrame(
        [(0, 5, 3, 0), (0, 15, 4, 0), (0, 20, 2, 1), (1, 30, 6, 1)], "cluster int, us bigint, event_id bigint, slice int"
    )
    got = history.value_at(asked, seen, "a").orderBy("us")
    assert [r[0] for r in values(got, "a")] == [None, 5.0, 7.0, None]


def test_run_statistics(spark):
    df = spark.createDataFrame([("k", v) for v in [1, 2, 2, 3, 4, 4, 4, 4, 4, 5]], "g string, v int")
    assert values(runs.grouped_median(df, ["g"], "v"), "grouped_median")[0][0] == pytest.approx(3.7)
    cut_up = Slices((("v"), "v"), ((2.0, 2.0), (4.0, 4.0)))
    sliced = runs.grouped_median(df, ["g"], "v", cut_up)
    assert values(sliced, "grouped_median")[0][0] == pytest.approx(3.7)
    assert one(spark, overhead_percent(F.lit(1260), F.lit(1400))) == pytest.approx(10.0)
    assert one(spark, margin95(F.lit(10.0))) == pytest.approx(4.3827, abs=1e-4)
    rates = spark.createDataFrame([("a", 100.0, 2.0), ("a", 100.0, 4.0)], "g string, mb double, s double")
    report = runs.io_consistent(runs.io_summary(rates, ["g"], "mb", "s"))
    assert values(report, "consistent") == [(True,)]


def test_logs(spark):
    lines = spark.createDataFrame(
        [("a", 1, "x Roll Edit Log"), ("a", 2, "y"), ("b", 1, "z BlockStateChange: BLOCK* w"), ("b", 2, "STARTUP_MSG")],
        "file string, n int, text string",
    )
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    counts = logs.pattern_counts(lines, files, logs.CHECKPOINT_DONE)
    assert sorted(values(counts, "file", "cnt")) == [("a", 1), ("b", 0), ("c", 0)]
    assert values(logs.pattern_mean(counts), "n_files")[0] == (3,)
    assert logs.clean(lines).count() == 3
    edits = spark.createDataFrame(
        [
            (f"2024-01-01 00:00:00,000 {logs.EDITS_LOADED} /e of size 9 edits # 12 loaded in 0 seconds",),
            ("WARN org.x.FSImage: Edits file /e of size 9 edits # 99 loaded in 0 seconds",),
            ("other",),
        ],
        "text string",
    )
    assert values(logs.token_mean(edits), "n_lines", "mean_token") == [(1, 12.0)]


def test_uniq_batches_nth(spark):
    rows = [(0, i, x, i // 2) for i, x in enumerate("aabaac")]
    df = spark.createDataFrame(rows, "k int, us bigint, x string, slice bigint")
    got = lists.uniq_consecutive(df, "x", ["k"], ["us"]).orderBy("us")
    assert [r[0] for r in values(got, "x")] == list("abac")
    batches = lists.fixed_batches(df, 2, 2, ["us"]).orderBy("us")
    assert values(batches, "batch", "place") == [(0, 0), (0, 1), (1, 0), (1, 1), (None, None), (None, None)]
    assert values(lists.batch_capacity(df, 2, 4), "available", "enough") == [(6, False)]
    assert values(lists.nth_per_group(df, 2, ["x"], ["us"]).orderBy("x"), "x", "us") == [("a", 1)]
    ids = lists.sequence_ids(df, ["us"]).orderBy("us")
    assert [r[0] for r in values(ids, "myid")] == [1, 2, 3, 4, 5, 6]


def test_tree_round_trip(spark):
    doc = '{"/": ["é\\"q", "/", {"a": ["5", "/a/", {"c": ["{x}", "/a/c/", {}]}], "b": ["", "/b/", {}]}]}'
    deep = '{"/": ["", "/", {}]}'
    df = spark.createDataFrame([(1, doc), (2, deep)], "snapshot int, doc string")
    flat = kvtree.flatten(df)
    assert sorted(values(flat.where("snapshot = 1"), "depth", "path", "name", "parent", "value")) == [
        (0, "/", "/", None, 'é"q'),
        (1, "/a/", "a", "/", "5"),
        (1, "/b/", "b", "/", ""),
        (2, "/a/c/", "c", "/a/", "{x}"),
    ]
    assert sorted(values(kvtree.nest(flat), "snapshot", "doc")) == [(1, doc), (2, deep)]
    unread = spark.createDataFrame([(1, "/", None)], "snapshot int, path string, value string")
    assert values(kvtree.nest(unread), "doc") == [('{"/": [0, "/", {}]}',)]


def test_upsert_and_diff(spark):
    a = spark.createDataFrame([("/a/", "1"), ("/b/", "2")], "path string, value string")
    b = spark.createDataFrame([("/b/", "2"), ("/c/", "3")], "path string, value string")
    assert sorted(values(kvtree.upsert(a, b), "path", "value", "action")) == [
        ("/a/", "1", "Unchanged"),
        ("/b/", "2", "Modified"),
        ("/c/", "3", "Created"),
    ]
    assert sorted(values(kvtree.diff(a, b), "path", "change")) == [
        ("/a/", "Removed"),
        ("/b/", "Unchanged"),
        ("/c/", "Created"),
    ]


def plain_pagerank(edges, n, damping=0.85):
    nodes = {x for e in edges for x in e}
    out = {s: [d for a, d in edges if a == s] for s in nodes}
    rank = {x: 1 / len(nodes) for x in nodes}
    for _ in range(n):
        lost = sum(rank[x] for x in nodes if not out[x])
        new = {x: (1 - damping) / len(nodes) + damping * lost / len(nodes) for x in nodes}
        for s in nodes:
            for d in out[s]:
                new[d] += damping * rank[s] / len(out[s])
        rank = new
    return rank


def test_pagerank_with_dangling_and_large_nodes(spark):
    rng = random.Random(5)
    edges = sorted({(0, d) for d in range(1, 25)} | {(rng.randrange(12), rng.randrange(25)) for _ in range(40)})
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = dict(values(workloads.pagerank(df, 4, edges_per_part=5), "node", "rank"))
    want = plain_pagerank(edges, 4)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert sum(got.values()) == pytest.approx(1.0)


def test_cadence():
    c = workloads.Cadence(mtbf_s=1000)
    assert c.next() == 1
    c.observe(1, 3.0)
    assert c.next() == 2
    c.observe(2, 4.0)
    assert c.estimate() == (pytest.approx(1.0), pytest.approx(2.0))
    assert c.next() == 10  # sqrt(2 * 2 * 1000) = 63 iterations, kept at the longest lineage
    c.mtbf_s = 4.0
    assert c.next() == 4


def test_sort_and_probes(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), "id")
    out = workloads.total_sort(df, ["x", "id"], 5)
    assert values(workloads.sort_check(out, ["x", "id"]), "n_rows", "overlaps") == [(1000, 0)]
    shuffled = df.repartition(5, "id").sortWithinPartitions("x", "id")
    assert values(workloads.sort_check(shuffled, ["x", "id"]), "overlaps")[0][0] > 0
    report = workloads.write_probe(out, str(tmp_path / "w")).first()
    assert report.n_files >= 5 and report.throughput > 0
    read = workloads.read_probe(spark.read.parquet(str(tmp_path / "w")))
    assert read.agg(F.sum("n_rows")).first()[0] == 1000
    assert runs.io_summary(read.withColumn("g", F.lit(0)), ["g"], "mb", "seconds").first().n_tasks >= 1


def test_sorted_partitions_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(workloads, "SORTED_ROWS", 200)
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("x"), "id")
    out = workloads.total_sort(df, ["x", "id"])
    assert values(workloads.sort_check(out, ["x", "id"]), "n_rows", "overlaps") == [(20_000, 0)]
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 1_000


def test_pi(spark):
    got = workloads.pi_random(spark, 2).first()
    assert got.n == 400_000 and got.pi == pytest.approx(3.1416, abs=0.02)


def test_step_join_keeps_types_and_ties(spark):
    steps = spark.createDataFrame([(60, 99), (80, 36), (60, 10), (None, 1), (90, None)], "threshold int, period int")
    totals = [60.0, 60.5, 80.0, 80.01, -1.0, None, 0.0]
    rows = [(t, i, i) for i, t in enumerate(totals)]
    df = spark.createDataFrame(rows, "total double, us bigint, event_id bigint")
    want = dict(zip(range(7), [10, 36, 36, 500, 500, None, 10]))
    got = policy.step_period_join(df, steps, 500)
    assert {r.event_id: r.period for r in got.collect()} == want
    few = policy.io_period(df, [(60, 99), (80, 36), (60, 10)], 500)
    assert {r.event_id: r.period for r in few.collect()} == want


def test_nest_adds_missing_ancestors(spark):
    nodes = spark.createDataFrame([(1, "/a/b/", "x"), (None, "/c/", None), (None, "/", "r")], "snapshot int, path string, value string")
    docs = {r.snapshot: r.doc for r in kvtree.nest(nodes).collect()}
    assert docs == {
        1: '{"/": ["", "/", {"a": ["", "/a/", {"b": ["x", "/a/b/", {}]}]}]}',
        None: '{"/": ["r", "/", {"c": [0, "/c/", {}]}]}',
    }


def test_flatten_long_values_and_broken_texts(spark):
    long = "x\\\"{" * 250_000
    doc = '{"/": ["' + long + '", "/", {"a": ["1", "/a/", {}]}]}'
    rows = [(1, doc), (2, "{" * 3_000), (3, None), (4, "no json")]
    flat = kvtree.flatten(spark.createDataFrame(rows, "snapshot int, doc string")).collect()
    assert sorted((r.snapshot, r.path) for r in flat) == [(1, "/"), (1, "/a/")]
    assert len(next(r.value for r in flat if r.path == "/")) == 750_000


def test_pagerank_without_edges(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint")
    assert workloads.pagerank(none, 3).count() == 0


def test_numbers_that_are_too_long(spark):
    lines = spark.createDataFrame([("TestDFSIO (AF) #99999999999 = 5 seg.",), ("TestDFSIO (AF) #3 = 5 seg.",)], "text string")
    good = lines.withColumns(text.run_fields(F.col("text"))).collect()
    assert [r.rep for r in good] == [None, 3]
    record = "2024-01-01 00:00:00,000 [myid:1] - INFO  [main:A@99999999999] - m"
    assert spark.createDataFrame([(record,)], "text string").select(text.record_fields(F.col("text"))["src_line"]).first()[0] is None
    assert one(spark, history.whole(F.lit("x"))) is None


def test_gated_candidates_in_the_dead_band(spark):
    rows = [(k, i, i, 100 + 9 * i, i // 4) for k in (0, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "cluster bigint, us bigint, event_id bigint, period bigint, slice bigint")
    said = policy.dead_band(policy.gated(df, F.col("cluster") == 0))
    assert {r.cluster for r in said.collect()} == {0}
    io = df.where("false")
    both = policy.controller(io, df, dynamic=F.col("cluster") == 1)
    assert {r.cluster for r in both.collect()} == {1}


def test_controller_refuses_slices_of_two_plans(spark):
    rows = spark.range(400).selectExpr("id % 3 as cluster", "id as us", "id as event_id", "60 + id % 50 as period")
    one_plan, other = Slices.plan(rows, ("us", "event_id")), Slices.plan(rows.where("us > 150"), ("us", "event_id"))
    io = one_plan.assign(rows.where("us % 7 = 0"))
    assert policy.controller(io, policy.without_repeats(one_plan.assign(rows))).count() > 0
    for mixed in (other.assign(rows), policy.without_repeats(other.assign(rows))):
        with pytest.raises(ValueError, match="plans"):
            policy.controller(io, mixed)
