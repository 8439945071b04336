import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from models import dead_band
from pacemark.operators.hysteresis import announce
from pacemark.operators.ordered import (
    Slices,
    key_total,
    last_known,
    last_n,
    previous,
    row_number,
    running_sum,
    scan,
)

ORDER = ["us", "event_id"]


def rows(seed, n=600, keys=4, ticks=None):
    """Most rows belong to key 0; with ``ticks`` most of them share a few order values."""
    rng = random.Random(seed)
    for i in range(n):
        key = 0 if rng.random() < 0.6 else rng.randrange(keys)
        us = rng.randrange(ticks) if ticks and rng.random() < 0.7 else i * 7
        yield key, us, i, rng.randrange(-50, 50), rng.choice([None, "a", "b", "c"])


def frame(spark, data):
    return spark.createDataFrame(list(data), "k int, us bigint, event_id bigint, x bigint, s string")


@pytest.mark.parametrize("ticks", [None, 2])
def test_scan_over_slices_equals_plain_windows(spark, ticks):
    df = frame(spark, rows(3, ticks=ticks))
    sliced = Slices.plan(df, ORDER, min_slices=9).assign(df)
    assert sliced.select("slice").distinct().count() > 5
    columns = {
        "sum": running_sum(F.col("x")),
        "rn": row_number(),
        "known": last_known(F.col("s")),
        "earlier": last_known(F.col("s"), before=True),
        "prior": previous(F.col("s")),
        "whole": key_total(F.col("x")),
    }
    a = scan(sliced, ["k"], ORDER, columns)
    w = Window.partitionBy("k").orderBy(*ORDER)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    b = sliced.withColumns(
        {
            "sum": F.sum("x").over(up_to),
            "rn": F.row_number().over(w).cast("bigint"),
            "known": F.last("s", True).over(up_to),
            "earlier": F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "prior": F.lag("s").over(w),
            "whole": F.sum("x").over(Window.partitionBy("k")),
        }
    )
    want = sorted(map(repr, b.collect()))
    assert sorted(map(repr, a.collect())) == want
    assert sorted(map(repr, scan(sliced, ["k"], ORDER, columns, None).collect())) == want


def test_slices_share_a_hot_tick(spark):
    df = frame(spark, ((0, 5, i, 1, None) for i in range(800)))
    plan = Slices.plan(df, ORDER, min_slices=8)
    sizes = [r[1] for r in plan.assign(df).groupBy("slice").count().collect()]
    assert sum(sizes) == 800 and max(sizes) < 300


def test_slices_of_few_rows(spark):
    for n in (0, 1):
        df = frame(spark, list(rows(1, n=n)))
        assert Slices.plan(df, ORDER).assign(df).count() == n


def test_last_n_across_blocks(spark):
    df = frame(spark, rows(4))
    seq = scan(df, ["k"], ORDER, {"seq": row_number()}, None)
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(-6, 0)
    got = last_n(seq, ["k"], "seq", 7, lambda w: {"m": F.avg("x").over(w)}, block=16)
    want = seq.withColumn("m", F.avg("x").over(w))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("threshold,seed", [(1, 0), (5, 1), (5, 2), (40, 3)])
def test_announce_equals_loop(spark, threshold, seed):
    rng = random.Random(seed)
    data, level = [], {}
    for i in range(1500):
        key = 0 if rng.random() < 0.7 else rng.randrange(3)
        level[key] = level.get(key, 100) + rng.randint(-3, 3) * rng.choice([0, 1, 1, threshold])
        data.append((key, i * 3, i, level[key], rng.random() < 0.2))
    df = spark.createDataFrame(data, "k int, us bigint, event_id bigint, period bigint, io boolean")
    df = Slices.plan(df, ORDER, min_slices=12).assign(df)
    got = announce(df, ["k"], ORDER, "period", threshold, 100, "io")
    want = set()
    for key in {r[0] for r in data}:
        mine = [r for r in data if r[0] == key]
        want |= {(key, mine[i][2], mine[i][3]) for i in dead_band([r[3:] for r in mine], 100, threshold)}
    assert {(r.k, r.event_id, r.period) for r in got.collect()} == want


def test_dead_band_by_hand(spark):
    values = [104, 105, 109, 110, 110, 103]
    df = spark.createDataFrame(
        [(0, i, i, v, i // 2) for i, v in enumerate(values)],
        "k int, us bigint, event_id bigint, period bigint, slice bigint",
    )
    got = announce(df, ["k"], ORDER, "period", 5, 100).orderBy("us").collect()
    assert [r.period for r in got] == [105, 110, 103]
    by_column = announce(df.withColumn("b", F.lit(100)), ["k"], ORDER, "period", 5, "b")
    assert by_column.count() == 3


def test_no_task_gets_a_whole_key(spark):
    """All rows have one key; every window partition still holds a slice only."""
    df = frame(spark, ((0, i, i, 1, None) for i in range(4000)))
    sliced = Slices.plan(df, ORDER, min_slices=16).assign(df)
    out = scan(sliced, ["k"], ORDER, {"sum": running_sum(F.col("x"))})
    largest = sliced.groupBy("k", "slice").count().agg(F.max("count")).first()[0]
    assert largest < 4000 / 4
    assert out.agg(F.max("sum")).first()[0] == 4000


def steady(kind, n, rng):
    level = 800
    for i in range(n):
        if kind == "jumps" and i % 9_000 == 8_999:
            level += rng.randint(-900, 900)
        yield level + (rng.randint(-2, 2) if kind != "constant" else 0)


@pytest.mark.parametrize("kind", ["constant", "near", "jumps"])
@pytest.mark.parametrize("threshold,slices", [(5, 1), (5, 10), (600, 10)])
def test_announce_on_steady_candidates(spark, kind, threshold, slices):
    rng, n = random.Random(7), 50_000
    values = list(steady(kind, n, rng))
    data = [(0, i, i, v, i * slices // n) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "k int, us bigint, event_id bigint, period bigint, slice bigint")
    got = announce(df, ["k"], ORDER, "period", threshold, 3600)
    want = dead_band([(v, False) for v in values], 3600, threshold)
    assert sorted(r.event_id for r in got.collect()) == want


def test_announce_with_null_keys_candidates_and_start(spark):
    data = [(None, i, i, 100 + 7 * i if i % 4 else None, i // 5, None) for i in range(20)]
    data += [(2, i, i, 100, i // 5, 100) for i in range(20)]
    kind = "k int, us bigint, event_id bigint, period bigint, slice bigint, start bigint"
    got = announce(spark.createDataFrame(data, kind), ["k"], ORDER, "period", 10, "start").collect()
    mine = [(r[2], (r[3], False)) for r in data if r[0] is None and r[3] is not None]
    want = dead_band([v for _, v in mine], -(10**9), 10)
    assert sorted((r.k, r.event_id) for r in got) == [(None, mine[i][0]) for i in want]


@pytest.mark.parametrize("seed", [1, 2])
def test_null_keys_are_a_key(spark, seed):
    """Sliced and plain scans agree where key parts are NULL and one key is hot."""
    rng = random.Random(seed)
    keys = [(None, None), (None, 1), (1, None), (1, 1)]
    data = [
        (*(keys[0] if rng.random() < 0.6 else rng.choice(keys)), i // 3, i, rng.randint(0, 9), rng.choice([None, "a", "b"]))
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "a int, b int, us bigint, event_id bigint, x bigint, s string")
    df = Slices.plan(df, ORDER, min_slices=7).assign(df)
    columns = {
        "sum": running_sum(F.col("x")),
        "known": last_known(F.col("s")),
        "prior": previous(F.col("s")),
        "whole": key_total(F.col("x")),
    }
    sliced = scan(df, ["a", "b"], ORDER, columns)
    assert sliced.count() == 400
    plain = scan(df, ["a", "b"], ORDER, columns, None)
    assert sorted(map(repr, sliced.collect())) == sorted(map(repr, plain.collect()))
