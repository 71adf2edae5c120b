"""Cutting the timelines of one-valued attributes into pieces that fit a task.

A group is one (e, a). Groups with a large share of the rows are cut by tx into blocks; each block
also gets the rows of earlier blocks that decide what holds when it begins: the latest assert before
it, and what came after that. Any block can then be worked through on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.skew import all_hot_keys, block_of, is_hot, partitions, quantile_edges

#: A hot group is cut into as many blocks as there are shuffle partitions, at least into these: as no group
#: is more than the whole, none of its blocks is then more than a partition's share.
LEAST_BLOCKS = 64
#: Rows of the table of hot groups' blocks that are broadcast; a larger one is joined by shuffle.
BROADCAST_BLOCKS = 200_000
KEY = ["e", "a"]


def plan(tables: Sequence[DataFrame], share: float | None = None, blocks: int | None = None) -> tuple[list[list[int]], list[int]]:
    """The hot keys (e, a) of each table, and the values of tx at which the rows of all of them are cut evenly."""
    hot = all_hot_keys(tables, KEY, share)
    every = sorted({k for x in hot for k in x})
    if not every:
        return hot, []
    rows = reduce(DataFrame.unionAll, [t.select(*KEY, "tx") for t in tables])
    return hot, quantile_edges(rows.where(is_hot(KEY, every)), "tx", blocks or max(partitions(rows), LEAST_BLOCKS))


def blocked(changes: DataFrame, hot: Sequence[int], edges: Sequence[int]) -> DataFrame:
    """``changes`` (e, a, v, tx, op) with the column ``block``, 0 for groups that are not hot.

    Rows of hot groups appear in their own block (1, 2, ...). Those not followed by an assert in it also
    appear in the blocks after it, up to the next one with an assert. What a row has to know for that, the
    latest assert in its block and the next block with one, is in a table with at most one row per hot
    group and block.
    """
    if not hot:
        return changes.withColumn("block", F.lit(0))
    own = changes.withColumn("own", F.when(is_hot(KEY, hot), block_of("tx", edges) + 1).otherwise(F.lit(0)))
    some = own.where(F.col("own") > 0)
    later = Window.partitionBy(*KEY).orderBy("own").rowsBetween(1, Window.unboundedFollowing)
    known = some.groupBy(*KEY, "own").agg(F.max(F.when(F.col("op") == 0, F.col("tx"))).alias("top"))
    known = known.withColumn("following", F.min(F.when(F.col("top").isNotNull(), F.col("own"))).over(later))
    last = F.when(F.col("top") > F.col("tx"), F.col("own")).otherwise(F.coalesce(F.col("following"), F.lit(len(edges) + 1)))
    blocks = F.when(F.col("own") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.col("own"), last))
    names = [*changes.columns, "block"]
    if len(hot) * (len(edges) + 1) <= BROADCAST_BLOCKS:  # one scan for all rows
        return own.join(F.broadcast(known), [*KEY, "own"], "left").withColumn("block", F.explode(blocks)).select(*names)
    cold = changes.where(~is_hot(KEY, hot)).withColumn("block", F.lit(0))
    return cold.unionByName(some.join(known, [*KEY, "own"]).withColumn("block", F.explode(blocks)).select(*names))


def regrouped(batches: Iterator[pa.RecordBatch], least: int = 50_000, least_bytes: int = 32_000_000) -> Iterator[tuple[pa.Table, bool]]:
    """Joins batches to tables of at least ``least`` rows or ``least_bytes``; says of each whether it is the last.

    As batches are bounded by the session in rows and bytes, so are the tables.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    ready: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= least or sum(x.nbytes for x in held) >= least_bytes:
            if ready is not None:
                yield ready, False
            ready, held, size = pa.Table.from_batches(held), [], 0
    if held:
        if ready is not None:
            yield ready, False
        ready = pa.Table.from_batches(held)
    if ready is not None:
        yield ready, True


def numbered(*cols: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the runs of equal tuples in columns sorted by them."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def first_retract(g: np.ndarray, code: np.ndarray, at: np.ndarray, op: np.ndarray, never: int) -> np.ndarray:
    """For each row, the position ``at`` of the next retract of its (g, code) after its own position."""
    n = len(g)
    order = np.lexsort((at, code, g))
    gs, cs, ts, ret = g[order], code[order], at[order], op[order] == 1
    run = numbered(gs, cs)
    spot = numbered(gs, cs, ts)
    # the retract position of each (g, code, at) spot, then the next one from the right within the run
    spots = spot[-1] + 1 if n else 0
    has = np.zeros(spots, bool)
    has[spot[ret]] = True
    first = np.searchsorted(spot, np.arange(spots))
    spot_at, spot_run = ts[first], run[first]
    index = np.where(has, np.arange(spots), spots)
    nxt = np.minimum.accumulate(index[::-1])[::-1]
    nxt = np.append(nxt[1:], spots)
    ok = (nxt < spots) & (spot_run[np.minimum(nxt, spots - 1)] == spot_run) if spots else np.zeros(0, bool)
    value = np.where(ok, spot_at[np.minimum(nxt, spots - 1)], never) if spots else np.zeros(0, at.dtype)
    out = np.empty(n, at.dtype)
    out[order] = value[spot]
    return out
