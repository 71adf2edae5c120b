"""Attributes as known at event time: events and changes meet by (entity, attribute), sorted by tx.

Within a group a vectorised binary search finds, for each event, the latest version asserted at or
before the event's tx, and whether it was retracted by then. Nothing of a later tx can be seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import timeline
from tidelog.operators.facts import ONE, facts, keys_of
from tidelog.operators.skew import block_of, is_hot, partitions

_ASK = 2


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (e, a, block, salt, tx, op, id); op 2 is an event."""
    held: pa.Table | None = None
    names = ["e", "a", "v", "tx", "op", "block", "salt", "id"]
    for table, end in timeline.regrouped(batches):
        t = table.select(names)
        old = held.num_rows if held is not None else 0
        if old:
            t = pa.concat_tables([held, t])
        e, a, tx, op, block, salt, ids = (t[c].to_numpy() for c in ("e", "a", "tx", "op", "block", "salt", "id"))
        coded = t["v"].combine_chunks().fill_null("").dictionary_encode()
        code = coded.indices.to_numpy()
        n = len(e)
        g = timeline.numbered(e, a, block, salt)
        change = np.flatnonzero(op != _ASK)
        # positions on a common axis of (group, tx)
        axis = timeline.numbered(g, tx)
        heads = np.searchsorted(axis, np.arange(axis[-1] + 1))
        dead = timeline.first_retract(g[change], code[change], axis[change], op[change], axis[-1] + 1)
        put = op[change] == 0
        at, until = axis[change][put], dead[put]
        if len(at):  # several values of one tx: the version lasts while one of them does
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            at, until = at[first], np.maximum.reduceat(until, first)
        ask = np.flatnonzero(op == _ASK)
        k = np.searchsorted(at, axis[ask], side="right") - 1
        ok = k >= 0
        ask, k = ask[ok], k[ok]
        v = heads[at[k]]
        ok = (g[v] == g[ask]) & (until[k] > axis[ask])
        ask, v = ask[ok], v[ok]
        if len(ask):  # whole-row repeats of an event lie side by side
            new = np.append(True, (axis[ask][1:] != axis[ask][:-1]) | (ids[ask][1:] != ids[ask][:-1]))
            new &= ask >= old
            ask, v = ask[new], v[new]
        # the last group may go on: keep what is alive, the last tx's changes, and the last event for its repeats
        keep = np.zeros(n, bool)
        if not end:
            mine = (at >= 0) & (g[heads[at]] == g[-1])
            if mine.any():
                last = np.flatnonzero(mine)[-1]
                rows = change[put]
                keep[rows[(axis[rows] == at[last]) & (dead[put] > axis[-1])]] = True
            keep[heads[axis[-1]] :] = op[heads[axis[-1]] :] != _ASK
            keep[-1] = True
        held = t.filter(pa.array(keep)) if not end else None
        yield pa.RecordBatch.from_arrays([pa.array(ids[ask]), pa.array(tx[v])], ["id", "tx"])


def as_of(changes: DataFrame, events: DataFrame, share: float | None = None, blocks: int | None = None, salts: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(id, tx) for each event (id, e, a, at) at whose tx ``at`` a value of one-valued (e, a) holds.

    ``changes`` are facts (e, a, v, tx, op); the resulting tx is that of the latest assert up to
    ``at``. Events with a null, without an earlier assert, or after the retract of all values of that
    assert give no row. Repeated events count once, repeated changes change nothing; other columns are
    ignored; either table may be empty.

    Groups with a large share of the changes or events are cut by tx into blocks (see timeline), evenly
    by the rows of both. Only where most of a group's events ask for one and the same tx does a block stay
    large; so the events of groups that are much asked for are also dealt to ``salts`` copies of the
    block's changes, by default one for each 64 shuffle partitions (of a group with a third of all events a
    block has a third of a partition's share; with all of them at one tx, a copy has 21 times it) and 8 at
    least. ``keys`` (e, a, tx) may stand for the changes where keys are counted (see history).
    """
    salts = salts or max(8, partitions(changes) // 64)
    rows = changes.select("e", "a", "v", "tx", F.col("op").cast("tinyint").alias("op")).dropna()
    asks = events.select("id", "e", "a", F.col("at").alias("tx")).dropna()
    (eager, asked), edges = timeline.plan([keys if keys is not None else rows, asks], share, blocks)
    hot = sorted({*eager, *asked})
    salted = is_hot(timeline.KEY, asked)
    left = timeline.blocked(rows, hot, edges)
    left = left.withColumn("salt", F.explode(F.when(salted, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))) if asked else left.withColumn("salt", F.lit(0))
    left = left.withColumn("id", F.lit(0).cast("long"))
    asks = asks.withColumn("block", F.when(is_hot(timeline.KEY, hot), block_of("tx", edges) + 1).otherwise(F.lit(0)) if hot else F.lit(0))
    asks = asks.withColumn("salt", F.when(salted, F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).otherwise(F.lit(0)) if asked else F.lit(0))
    asks = asks.withColumn("v", F.lit(None).cast("string")).withColumn("op", F.lit(_ASK).cast("tinyint"))
    key = [*timeline.KEY, "block", "salt"]
    met = left.unionByName(asks).repartition(*key).sortWithinPartitions(*key, "tx", "op", "id")
    return met.select("e", "a", "v", "tx", "op", "block", "salt", "id").mapInArrow(_search, "id long, tx long")


def read_as_of(datoms: DataFrame, attrs: DataFrame, reads: DataFrame) -> DataFrame:
    """(read_id, tx) of the reads (read_id, e, a, basis_tx) for which a value held at basis_tx."""
    one = facts(datoms, attrs).where(F.col("card") == ONE)
    asks = reads.select(F.col("read_id").alias("id"), "e", "a", F.col("basis_tx").alias("at"))
    return as_of(one, asks, keys=keys_of(datoms, attrs, ONE)).withColumnRenamed("id", "read_id")
