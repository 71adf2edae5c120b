"""Leaks against a search for every run of twelve words."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import containment


def brute_words(text):
    out, word = [], ""
    for c in unicodedata.normalize("NFKC", text or "").lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(docs, items, run):
    def runs(t):
        w = brute_words(t)
        return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}

    have = [(i, runs(t)) for i, t in items if i is not None]
    return {(d, i) for d, t in docs if d is not None for i, r in have if r & runs(t)}


def case(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ﬁn", "２０", "straße", "x²"]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, text(r.randint(5, 60))) for i in range(25)] + [(90, None), (91, ""), (None, text(20))]
    docs = []
    for d in range(120):
        t = text(r.randint(0, 80)).split(" ")
        if r.random() < 0.6:
            src = r.choice(items[:25])[1].split(" ")
            n = r.choice([5, 11, 12, 13, 30])
            k = r.randint(0, max(0, len(src) - n))
            p = r.randint(0, len(t))
            t[p:p] = [w.upper() if r.random() < 0.3 else w for w in src[k : k + n]]
        docs.append((d, r.choice([" ", "\n", " — ", ", "]).join(t)))
    docs += docs[:5] + [(500, None), (501, ""), (None, items[0][1]), (502, text(20_000) + " " + items[3][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("run, bits", [(12, 20), (12, 8), (3, 20), (7, 20)])
def test_leaks(spark, seed, run, bits):
    docs, items = case(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash")).withColumn("id", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1))
    got = [tuple(x) for x in containment.leaks(d, i, run=run, filter_bits=bits).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, items, run)
    assert containment.leaks(d.limit(0), i, filter_bits=12).count() == 0
    assert containment.leaks(d, i.limit(0)).count() == 0


def test_signatures_are_least_shingle_hashes():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 100).astype(np.uint64)
    for run in (5, 6, 9, 12, 13, 20):
        one = [containment.signatures(h[i : i + run], run)[0] for i in range(100 - run + 1)]
        assert containment.signatures(h, run).tolist() == one
        shingles = [containment.signatures(h[i : i + 5], 5)[0] for i in range(96)]
        assert one == [min(shingles[i : i + run - 4]) for i in range(100 - run + 1)]
    assert len(containment.signatures(h[:11], 12)) == 0


def test_filter_misses_nothing_and_lets_little_through(spark):
    r = np.random.default_rng(2)
    sig = r.integers(0, 2**64, 5_000, np.uint64)
    df = spark.createDataFrame([(int(x),) for x in sig.view(np.int64)], "sig long").repartition(3)
    f = containment._filter(df, 18)
    assert len(f.words) == 2**12 and f.may_have(sig).all()
    assert f.may_have(r.integers(0, 2**64, 100_000, np.uint64)).mean() < 0.005
    assert not containment._filter(df.limit(0), 8).may_have(sig).any()


def test_documents_are_read_once_however_many_items(spark, tmp_path):
    docs, items = case(3)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    many = spark.createDataFrame([(i * 1000 + k, t) for k in range(40) for i, t in items if i is not None], "item_id long, text string")
    got = containment.leaks(spark.read.parquet(str(tmp_path / "d")), many, filter_bits=16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan
    assert {(d, i // 1000) for d, i in map(tuple, got.collect())} == brute(docs, items, 12)


def test_a_passage_in_a_third_of_the_documents(spark):
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randint(0, 3000)}" for _ in range(n))
    items = [(i, text(30)) for i in range(20)]
    docs = [(d, text(60) + " " + (items[d % 2][1] if d % 3 == 0 else "") + " " + text(40)) for d in range(900)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = containment.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:3], "item_id long, text string"), filter_bits=16).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 300 and {tuple(x) for x in got} == {(d, d % 2) for d in range(0, 900, 3)}
