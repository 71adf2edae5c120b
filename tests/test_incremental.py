"""Runs over a changing source: nothing skipped or repeated, failures included."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.operators import incremental


def test_next_cut_and_changes(spark):
    r = random.Random(3)
    t0 = datetime(2020, 1, 1)
    cuts = sorted({t0 + timedelta(hours=r.randint(0, 900)) for _ in range(25)})
    runs = [(i, c, r.choice(["succeeded", "succeeded", "failed", None])) for i, c in enumerate(cuts)]
    rows = [(r.randint(0, 12), r.randint(0, 2), r.choice([None, "{}", '{"a":1,"b":2}', '{ "b": 2, "a": 1 }', '{"a":3}', "broken"]), t0 + timedelta(minutes=30 * i - 3000)) for i in range(2000)]
    rows = [x for x in rows if r.random() < 0.3] + [(1, 1, None, None), (None, 1, None, t0)]
    rows += [(99, 1, None, cuts[3]), (98, 1, None, cuts[3] + timedelta(microseconds=1))]

    def content(x):
        ids = {None: (), "{}": (), '{"a":1,"b":2}': (1, 2), '{ "b": 2, "a": 1 }': (1, 2), '{"a":3}': (3,), "broken": "broken"}[x[2]]
        return x[1], ids

    want, before = set(), {}
    for i, c, s in runs:
        if s == "succeeded":
            now = {}
            for x in sorted((x for x in rows if x[0] is not None and x[3] is not None and x[3] <= c), key=lambda x: x[3]):
                now[x[0]] = content(x)
            want |= {(i, k) for k in now if k not in before or before[k] != now[k]}
            before = now
    d = spark.createDataFrame(rows + rows[:20], "tx_id long, n_datoms long, temp_ids string, arrived_at timestamp").withColumn("bucket", F.lit("clash")).withColumn("delivery_id", F.xxhash64("tx_id", "arrived_at"))
    u = spark.createDataFrame(runs, "run_id long, cut_at timestamp, status string")
    got = incremental.result_changes(d, u)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = incremental.changes_by_run(d.select(F.col("tx_id").alias("key"), F.to_json(F.struct("n_datoms", incremental.mapping_text("temp_ids").alias("ids"))).alias("content"), F.col("arrived_at").alias("at"), F.col("delivery_id").alias("no")), u.where("status = 'succeeded'").withColumnRenamed("cut_at", "cut"), buckets=2)
    assert sorted(map(tuple, few.collect())) == sorted(want)
    assert incremental.result_changes(d.limit(0), u).count() == 0
    assert incremental.result_changes(d, u.limit(0)).count() == 0


def at(minute):
    return datetime(2020, 1, 1) + timedelta(minutes=minute)


@pytest.mark.parametrize(
    "first, then, changed",
    [
        ("{}", None, False),
        ("{}", "", False),
        ("{}", "null", False),
        ('{"a":1,"b":2}', ' { "b" : 2 , "a" : 1 } ', False),
        ('{"a":1}', '{"\\u0061":1}', False),
        ('{"a":1}', '{"a":7,"a":1}', False),
        ('{"a":7}', '{"a":7,"a":1}', True),
        ('{"a":1}', '{"a":"1"}', False),
        ('{"a":1}', '{"a":1.0}', True),
        ('{"a":1}', '{"a":null}', True),
        ("broken", "broken ", True),
        ("{}", "broken", True),
    ],
)
def test_what_is_the_same_content(spark, first, then, changed):
    d = spark.createDataFrame([(1, 5, 2, first, at(1)), (2, 5, 2, then, at(11))], "delivery_id long, tx_id long, n_datoms long, temp_ids string, arrived_at timestamp")
    u = spark.createDataFrame([(1, at(10), "succeeded"), (2, at(20), "succeeded")], "run_id long, cut_at timestamp, status string")
    assert sorted(map(tuple, incremental.result_changes(d, u).collect())) == [(1, 5)] + [(2, 5)] * changed


def test_ties_of_deliveries_and_cuts(spark):
    rows = [(1, 5, 9, "{}", at(1)), (2, 5, 3, "{}", at(1)), (3, 5, 3, "{}", at(10)), (4, 6, None, "{}", at(10)), (5, 6, None, "{}", at(12)), (6, 7, 1, "{}", at(30)), (7, 8, 1, "{}", at(31))]
    d = spark.createDataFrame(rows, "delivery_id long, tx_id long, n_datoms long, temp_ids string, arrived_at timestamp")
    u = spark.createDataFrame([(4, at(10), "succeeded"), (3, at(10), "succeeded"), (9, at(20), "failed"), (8, at(30), "succeeded"), (7, None, "succeeded")], "run_id long, cut_at timestamp, status string")
    assert sorted(map(tuple, incremental.result_changes(d, u).collect())) == [(3, 5), (3, 6), (8, 7)]


def test_fingerprints_decide_which_buckets_are_compared(spark):
    """Buckets that only got repeats have the fingerprint they had; a content that comes back later is a change each time."""
    rows = [(k, "x", cut, k) for k in range(4) for cut in (1, 2, 3)] + [(9, "x", 1, 9), (9, "y", 2, 9), (9, "x", 3, 9), (8, None, 2, 8), (8, None, 3, 8)]
    last = spark.createDataFrame(rows, "key long, content string, cut long, bucket int")
    got = sorted((r.bucket, r.cut) for r in incremental.changed_buckets(last).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (3, 1), (8, 2), (9, 1), (9, 2), (9, 3)]
    # two keys that swap their contents have another fingerprint, as the key is part of the hash
    swap = spark.createDataFrame([(1, "x", 1, 0), (2, "y", 1, 0), (1, "y", 2, 0), (2, "x", 2, 0)], "key long, content string, cut long, bucket int")
    assert incremental.changed_buckets(swap).count() == 4


def test_plan_uses_the_sums_and_moves_keys_twice(spark):
    d = spark.createDataFrame([(1, 1, 1, "{}", at(1))], "delivery_id long, tx_id long, n_datoms long, temp_ids string, arrived_at timestamp")
    u = spark.createDataFrame([(1, at(10), "succeeded")], "run_id long, cut_at timestamp, status string")
    p = incremental.result_changes(d, u)._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64(key" in p and "sum(" in p and "NOT (dh" in p
    assert p.count("Exchange hashpartitioning(key") == 1 and p.count("Exchange hashpartitioning(bucket") == 1


class Lost(RuntimeError):
    pass


def lost(*_, **__):
    raise Lost


def sums(rows):
    return rows.groupBy("bucket", "k").agg(F.sum("v").alias("s"))


def content(df):
    return sorted((r.k, r.s) for r in df.collect())


def want(source):
    return content(source.groupBy("k").agg(F.sum("v").alias("s")))


def numbers(spark, change=()):
    change = dict(change)
    return spark.createDataFrame([(k, change.get(k, k % 7)) for k in range(40) if change.get(k, 0) is not None], "k long, v long")


@pytest.fixture
def table(spark, tmp_path):
    return incremental.IncrementalTable(spark, str(tmp_path / "t"), "k", buckets=8)


@pytest.mark.parametrize("step", ["fingerprints", "compute", "while writing", "publish"])
def test_a_run_that_fails_changes_nothing(spark, table, step, monkeypatch):
    first, second = numbers(spark), numbers(spark, {3: 100, 5: None})
    assert len(table.run("r1", first, sums)) == 8
    with monkeypatch.context() as m:
        compute = sums
        if step == "fingerprints":
            m.setattr(incremental, "fingerprints", lost)
        elif step == "compute":
            compute = lost
        elif step == "while writing":  # some buckets are written, others not
            compute = lambda rows: sums(rows).withColumn("s", F.when(F.col("k") == 3, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("s")))
        else:
            m.setattr(table.runs, "publish", lost)
        with pytest.raises(Exception):
            table.run("r2", second, compute)
    assert table.last_run() == "r1" and content(table.read()) == want(first)
    # back to the old source: nothing has changed, and nothing is lost
    assert table.run("r3", first, sums) == []
    assert content(table.read()) == want(first)
    assert 1 <= len(table.run("r4", second, sums)) <= 2
    assert content(table.read()) == want(second)


def test_failed_run_then_the_same_run_again(spark, table, monkeypatch):
    first, second = numbers(spark), numbers(spark, {3: 100})
    table.run("r1", first, sums)
    with monkeypatch.context() as m:
        m.setattr(table.runs, "publish", lost)
        with pytest.raises(Lost):
            table.run("r2", second, sums)
    assert len(table.run("r2", second, sums)) == 1
    assert content(table.read()) == want(second) and table.run("r2", second, sums) == []


def test_only_changed_buckets_are_read_and_replaced(spark, table):
    seen = []

    def compute(rows):
        seen.append({r.bucket for r in rows.select("bucket").distinct().collect()})
        return sums(rows)

    first = numbers(spark)
    table.run("r1", first, compute)
    assert table.run("r2", first, compute) == [] and len(seen) == 1
    second = numbers(spark, {3: 100, 11: None})
    changed = {r.b for r in spark.createDataFrame([(3,), (11,)], "k long").select(incremental.bucket_of("k", 8).alias("b")).collect()}
    assert set(table.run("r3", second, compute)) == changed == seen[1]
    assert content(table.read()) == want(second)
    # a bucket that becomes empty
    gone = second.where(incremental.bucket_of("k", 8) != 2)
    assert table.run("r4", gone, compute) == [2] and content(table.read()) == want(gone)
    table.vacuum()
    assert content(table.read()) == want(gone)


def test_empty_source_and_nothing_run_yet(spark, table):
    assert table.last_run() is None and table.read().count() == 0
    assert table.run("r1", numbers(spark).limit(0), sums) == [] and table.read().count() == 0
    assert len(table.run("r2", numbers(spark), sums)) == 8 and table.read().count() == 40
    assert len(table.run("r3", numbers(spark).limit(0), sums)) == 8 and table.read().count() == 0
