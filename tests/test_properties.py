"""Properties over generated values: rows of a log, EDN, and numbers of runs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.functions import values as V
from tidelog.operators import history, timeline
from tidelog.plans import edn

ids = st.integers(0, 2**63 - 1)
vals = st.one_of(
    st.just(V.Value(0)),
    st.integers(-(2**63), 2**63 - 1).map(V.i64),
    st.integers(0, 2**64 - 1).map(V.u64),
    st.decimals(allow_nan=False, allow_infinity=False, places=18, min_value=-(10**19), max_value=10**19).map(V.dec),
    st.text().map(V.value),
    ids.map(V.ref),
)


@given(ids, ids, vals, ids, st.sampled_from([V.ASSERT, V.RETRACT]))
def test_rows_hold_their_value(e, a, v, tx, op):
    row = V.datom(e, a, v, tx, op)
    assert len(row) == len(V.LOG_SCHEMA) and (row[0], row[1], row[8], row[9]) == (e, a, tx, op)
    assert V.value_of(row) == v and V.value_of(row[2:8]) == v
    assert sum(x is not None for x in row[3:8]) == (v.tag != V.NIL)


@given(vals, vals)
def test_values_order_by_type_first(x, y):
    assert (x == y) == (x.tag == y.tag and x.content == y.content)
    if x.tag != y.tag:
        assert (x < y) == (x.tag < y.tag)


names = st.from_regex(r"[a-z?*!<>=][a-z0-9?.*-]{0,8}(/[a-z][a-z0-9-]{0,5})?", fullmatch=True).filter(lambda s: s not in ("nil", "true", "false"))
atoms = st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(), names.map(edn.Symbol), names.map(edn.Keyword))
forms = st.recursive(
    atoms,
    lambda x: st.one_of(st.lists(x, max_size=4).map(edn.Vector), st.lists(x, max_size=4).map(tuple), st.dictionaries(names.map(edn.Keyword), x, max_size=3), st.frozensets(names.map(edn.Symbol), max_size=4)),
    max_leaves=12,
)


@settings(max_examples=200)
@given(forms)
def test_edn_reads_what_it_writes(x):
    assert edn.read(edn.write(x)) == x
    assert edn.read(f" , {edn.write(x)} ; note") == x


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 200)), max_size=200))
def test_bitmaps_join_and_split_runs(bits):
    got = list(zip(*(x.tolist() for x in history.bit_runs(*(np.array([s[i] for s in bits], np.int64) for i in range(2))))))
    want = []
    for p in sorted({s[0] for s in bits}):
        mine = {i for q, i in bits if q == p}
        for i in sorted(mine):
            if i - 1 not in mine:
                want.append((p, i, next(j for j in range(i, 202) if j not in mine)))
    assert got == want


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 6), st.integers(0, 1)), min_size=1, max_size=30))
def test_next_retract(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    g, code, at, op = (np.array(c, np.int64) for c in zip(*rows))
    got = timeline.first_retract(g, code, at, op, 99).tolist()
    want = [min([y[2] for y in rows if y[3] == 1 and y[:2] == x[:2] and y[2] > x[2]], default=99) for x in rows]
    assert got == want
