"""Plain Python versions of what the operators compute, and small made-up logs."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import types as T

LOG = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("e", T.LongType()), ("a", T.LongType()), ("vt", T.ByteType()), ("v_i64", T.LongType()), ("v_u64", T.DecimalType(20, 0)),
        ("v_dec", T.DecimalType(38, 18)), ("v_str", T.StringType()), ("v_ref", T.LongType()), ("tx", T.LongType()), ("op", T.ByteType()),
    ]]
)
ATTRS = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("id", T.LongType()), ("attr_version", T.LongType()), ("ident", T.StringType()), ("value_type", T.ByteType()), ("card", T.ByteType()),
        ("doc", T.StringType()), ("is_unique", T.BooleanType()),
    ]]
)
CHANGES = "e long, a long, v string, tx long, op tinyint"

#: id, ident, type, cardinality
SCHEMA = [(8, "movie/name", 4, 0), (9, "movie/year", 2, 0), (10, "movie/director", 5, 1), (11, "movie/cast", 5, 1), (21, "movie/gross", 3, 0), (22, "movie/producer", 5, 0), (14, "person/born", 1, 0), (15, "person/likes", 4, 1)]
LANE = {1: "v_i64", 2: "v_u64", 3: "v_dec", 4: "v_str", 5: "v_ref"}


def datom(e, a, vt, value, tx, op=0):
    row = {"e": e, "a": a, "vt": vt, "v_i64": None, "v_u64": None, "v_dec": None, "v_str": None, "v_ref": None, "tx": tx, "op": op}
    if vt in LANE and value is not None:
        row[LANE[vt]] = Decimal(value) if vt in (2, 3) else value
    return tuple(row.values())


def attr_rows():
    return [(i, 7, ident, vt, card, None, False) for i, ident, vt, card in SCHEMA] + [(6, 0, "db/tx/time", 2, 0, None, False)]


def random_log(seed, n=400, hot=True):
    """A log with repeats, ties, gaps, unknown attributes, wrong types, nulls and, if wanted, one key with a third of it."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        a, _, vt, _ = r.choice(SCHEMA)
        e = r.randint(100, 108)
        if hot and r.random() < 0.4:
            a, vt, e = 8, 4, 100
        value = {1: r.randint(-2, 2), 2: r.randint(0, 2), 3: r.choice(["1.50", "2", "-0.25"]), 4: r.choice("abc") if r.random() < 0.9 else "", 5: r.choice([100, 101, 105, 999, 108])}[vt]
        rows.append(datom(e, a, vt, value, r.randint(20, 80), int(r.random() < 0.35)))
    rows += r.sample(rows, n // 10)
    rows += [datom(101, 8, 1, 5, 30), datom(101, 8, 0, None, 31), datom(101, 77, 4, "x", 33), datom(101, 8, 4, None, 90), datom(None, 8, 4, "q", 30), datom(101, None, 4, "q", 30), datom(101, 8, 4, "q", None)]
    rows += [datom(t, 6, 2, 1_500_000_000 + 86_400 * 9 * t, t) for t in range(20, 81)]
    r.shuffle(rows)
    return rows


def text(row):
    d = dict(zip(LOG.names, row))
    v = d[LANE[d["vt"]]] if d["vt"] in LANE else None
    return None if v is None else f"{v:.18f}" if d["vt"] == 3 else str(v)


def facts_of(rows):
    kinds = {i: (vt, card) for i, _, vt, card in SCHEMA} | {6: (2, 0)}
    out = set()
    for row in rows:
        e, a, vt, tx, op = row[0], row[1], row[2], row[8], row[9]
        if a in kinds and kinds[a][0] == vt and None not in (e, tx, op, text(row)):
            out.add((e, a, text(row), tx, op))
    return out, {a: card for a, (_, card) in kinds.items()}


def held_at(facts, cards, t):
    """{(e, a, v): tx of its latest assert} of what holds at t, straight from the definition."""
    asserts, retracts, last = defaultdict(list), defaultdict(list), {}
    for e, a, v, tx, op in facts:
        if tx <= t:
            (retracts if op else asserts)[e, a, v].append(tx)
            if not op:
                last[e, a] = max(tx, last.get((e, a), tx))
    out = {}
    for (e, a, v), txs in asserts.items():
        m = max(txs)
        if (cards[a] == 1 or m == last[e, a]) and not any(x > m for x in retracts[e, a, v]):
            out[e, a, v] = m
    return out


def periods(facts, cards):
    """[(e, a, v, from, to)] by asking at every tx what holds."""
    one = {f for f in facts if cards[f[1]] == 0}
    txs = sorted({f[3] for f in one})
    runs, live = [], {}
    for t in txs:
        now = held_at(one, cards, t)
        for k in [k for k in live if k not in now]:
            runs.append((*k, live.pop(k), t))
        for k in now:
            live.setdefault(k, t)
    return sorted(runs + [(*k, t, -1) for k, t in live.items()])
