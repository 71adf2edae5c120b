"""That plans are the ones wanted: pushed filters, pruned columns, one scan for a star, no needless shuffles."""

import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from tests import brute
from tidelog.operators import eager, history, skew
from tidelog.operators.facts import facts, states
from tidelog.plans.planner import Database
from tidelog.sources.importer import star_tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_star_is_one_scan_of_its_columns(spark, small):
    db = Database(tables=star_tables(spark, small, ["lineitem", "orders"]))
    p = plan(db.q("[:find ?f (count) (sum ?q) :where [?l :line/returnflag ?f] [?l :line/quantity ?q] [?l :line/order ?o] [?o :order/status \"F\"]]"))
    assert p.count("FileScan") == 2 and "xxhash64" not in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in p
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", p)
    assert "Cartesian" not in p and "NestedLoop" not in p


def test_predicates_reach_the_scan(spark, small):
    db = Database(tables=star_tables(spark, small, ["part"]))
    p = plan(db.q("[:find ?n :where [?p :part/name ?n] [?p :part/brand \"Brand#3\"]]"))
    assert "EqualTo(p_brand,Brand#3)" in p and "Exchange" not in p


def test_states_shuffle_once(spark, small):
    datoms, attrs = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("datoms", "attrs"))
    f = facts(datoms, attrs, [8, 9])
    p = plan(states(f, hot=[]))
    assert p.count("Exchange hashpartitioning(e") == 1 and "In(a, [8,9])" in p


def test_totals_combine_before_each_shuffle(spark, small):
    datoms, attrs = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("datoms", "attrs"))
    p = plan(eager.attribute_totals(datoms, attrs, share=1.0))  # no key is hot
    assert "SortAggregate" not in p.split("value_type")[0] and p.count("partial_") >= 3
    # where no key is hot, rows move by (a, e), and then only counts by (a, vt)
    moves = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", p))
    assert [m for m in moves if m.startswith("a, e,")] and not [m for m in moves if m.startswith("a, vt, e, 4")]


def test_hot_keys(spark):
    rows = [(1, i) for i in range(500)] + [(2, i) for i in range(300)] + [(10 + i, 0) for i in range(1200)]
    df = spark.createDataFrame(rows, "k long, x long").repartition(7)
    h = {r.k: r.h for r in df.select("k", skew.key_hash(["k"]).alias("h")).distinct().collect()}
    assert skew.hot_keys(df, ["k"], 0.2) == [h[1]]
    assert skew.hot_keys(df, ["k"], 0.1) == sorted([h[1], h[2]])
    assert skew.hot_keys(df, ["k"], 0.9) == [] == skew.hot_keys(df.limit(0), ["k"])
    assert skew.hot_share(df) <= skew.HOT_SHARE
    assert len(skew.hot_keys(df, ["k"], 1e-7)) == len(h)  # beyond what a summary can track
    few = spark.createDataFrame([(5, 5)] * 3 + [(6, 1)], "k long, x long")
    assert [len(x) for x in skew.all_hot_keys([df, few, few.limit(0)], ["k"], 0.2)] == [1, 2, 0]
    many = [r.h for r in spark.range(300).select(skew.key_hash(["id"]).alias("h")).collect()]
    assert spark.range(1000).where(skew.is_hot(["id"], many)).count() == 300


def test_summaries_meet_in_two_steps(spark, monkeypatch):
    """A summary of all map tasks never goes to one task: first groups of tasks, then the groups."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect, first = [], DataFrame.collect, DataFrame.first
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(plan(self)) or collect(self))
    monkeypatch.setattr(DataFrame, "first", lambda self: seen.append(plan(self)) or first(self))
    df = spark.range(1000, numPartitions=32).withColumn("k", F.col("id") % 7)
    skew.all_hot_keys([df, df], ["k"])
    skew.quantile_edges(df, "k", 8)
    assert len(seen) >= 2
    for p in (seen[0], seen[-1]):
        exchanges = re.findall(r"Exchange (?:hashpartitioning\((.*?)\)|SinglePartition)", p)
        assert len(exchanges) == 2 and re.search("_nondeterministic|_groupingexpression", exchanges[-1])


def test_quantile_blocks(spark):
    df = spark.range(1000).withColumn("t", F.when(F.col("id") < 600, 5).otherwise(F.col("id")))
    edges = skew.quantile_edges(df, "t", 4)
    assert edges == sorted(set(edges)) and len(edges) <= 3
    got = df.groupBy(skew.block_of("t", edges).alias("b")).agg(F.min("t"), F.max("t")).orderBy("b").collect()
    assert all(a["max(t)"] < b["min(t)"] for a, b in zip(got, got[1:]))
    assert skew.quantile_edges(df.limit(0), "t", 4) == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 66, 100, 121, 122, 500, 1023])
def test_block_numbers(spark, n):
    edges = sorted(random.Random(n).sample(range(10, 5_000), n))
    got = spark.range(5_010).select("id", skew.block_of("id", edges).alias("b")).collect()
    assert [r.b for r in sorted(got)] == [bisect.bisect_right(edges, i) for i in range(5_010)]


def test_only_hot_groups_take_the_block_path(spark):
    attrs = spark.createDataFrame(brute.attr_rows(), brute.ATTRS)
    even = spark.createDataFrame([brute.datom(i, 8, 4, "x", 20 + i % 7) for i in range(2000)], brute.LOG)
    assert "Generate explode" not in plan(history.history(facts(even, attrs)))
    skewed = spark.createDataFrame([brute.datom(1, 8, 4, str(i), 20 + i) for i in range(2000)], brute.LOG)
    p = plan(history.history(facts(skewed.union(even), attrs)))
    assert "Generate explode" in p
