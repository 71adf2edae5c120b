"""History of changing entity attributes: presence bitmaps over an entity-attribute's snapshots.

The snapshots of an (entity, attribute) are the transactions that touch it; between two of them
nothing changes. Each (entity, attribute, value) has a bitmap in which the bit of every snapshot is set
that finds the value held, in words of 64 of which only those with a bit set exist. Nothing else says how
long a value lasts: runs of consecutive bits are the validity periods, and a gap (retracted, later
asserted again) ends one run and begins another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import timeline
from tidelog.operators.facts import ONE, facts, keys_of
from tidelog.operators.skew import is_hot

NEVER = -1
WORD = 64

_OUT = "e long, a long, v string, from_tx long, to_tx long, block int, left boolean, right boolean"


def bit_runs(pair: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets bit ``at`` in bitmap ``pair``, row by row, and returns the runs of set bits (pair, begin, end)."""
    if not len(pair):
        return pair, at, at
    order = np.lexsort((at, pair))
    p, word, bit = pair[order], at[order] // WORD, np.uint64(1) << (at[order] % WORD).astype(np.uint64)
    first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (word[1:] != word[:-1])))
    bits, p, word = np.bitwise_or.reduceat(bit, first), p[first], word[first]
    # one row of 64 cells a word; the runs of set cells, joined where the next word goes on
    cells = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    goes_on = (p[1:] == p[:-1]) & (word[1:] == word[:-1] + 1)
    before = np.empty_like(cells)
    before[:, 1:] = cells[:, :-1]
    before[:, 0] = np.append(False, cells[:-1, -1] & goes_on)
    after = np.empty_like(cells)
    after[:, :-1] = cells[:, 1:]
    after[:, -1] = np.append(cells[1:, 0] & goes_on, False)
    w, b = np.nonzero(cells & ~before)
    w2, b2 = np.nonzero(cells & ~after)
    return p[w], word[w] * WORD + b, word[w2] * WORD + b2 + 1


def presence(g: np.ndarray, snap: np.ndarray, code: np.ndarray, op: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group * codes + code, snapshot) for each value and each snapshot at which it is held.

    Rows are sorted by group and snapshot; a snapshot is seen by itself: what the latest assert up to it
    has put, less what a retract after that assert, and up to the snapshot, has taken away.
    """
    n, codes = int(snap[-1]) + 1, int(code.max()) + 1
    heads = np.searchsorted(snap, np.arange(n))
    group = g[heads]
    put = op == 0
    asserted = np.unique(snap[put] * codes + code[put])
    by, value = asserted // codes, asserted % codes
    latest = np.full(n, -1)
    latest[by] = by
    latest = np.maximum.accumulate(latest)
    latest[(latest >= 0) & (group[latest] != group)] = -1  # of an earlier group
    low, high = np.searchsorted(by, latest, "left"), np.searchsorted(by, latest, "right")
    many = np.where(latest >= 0, high - low, 0)
    at = np.repeat(np.arange(n), many)
    v = value[np.repeat(low, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
    pair = group[at] * codes + v
    # the last retract of the value in the group up to the snapshot
    taken = np.unique((g[~put] * codes + code[~put]) * n + snap[~put])
    k = np.searchsorted(taken, pair * n + at, "right") - 1
    ended = np.zeros(len(at), bool)
    some = k >= 0
    ended[some] = (taken[k[some]] // n == pair[some]) & (taken[k[some]] % n > latest[at[some]])
    return pair[~ended], at[~ended]


def _periods(edges: list[int]):
    """A function for mapInArrow over rows sorted by (e, a, block, tx)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # what still holds in the last group, as asserts at its last assert's tx
        for table, end in timeline.regrouped(batches):
            t = table.append_column("start", table["tx"])
            if held is not None:
                t = pa.concat_tables([held, t.select(held.column_names)])
            e, a, block, tx, op, start = (t[c].to_numpy() for c in ("e", "a", "block", "tx", "op", "start"))
            code = t["v"].combine_chunks().dictionary_encode()
            words = code.dictionary
            code = code.indices.to_numpy().astype(np.int64)
            if not end:  # the last snapshot may go on in the next table
                cut = np.flatnonzero((e != e[-1]) | (a != a[-1]) | (block != block[-1]) | (tx != tx[-1]))
                cut = cut[-1] + 1 if len(cut) else 0
                rest = t.slice(cut)
                e, a, block, tx, op, start, code = (x[:cut] for x in (e, a, block, tx, op, start, code))
                if not cut:
                    held = rest.select(["e", "a", "v", "tx", "op", "block", "start"])
                    continue
            g = timeline.numbered(e, a, block)
            snap = timeline.numbered(e, a, block, tx)
            n, codes = int(snap[-1]) + 1, int(code.max()) + 1
            heads = np.searchsorted(snap, np.arange(n))
            snap_g, snap_tx = g[heads], tx[heads]
            group_end = np.append(np.flatnonzero(snap_g[1:] != snap_g[:-1]) + 1, n)[snap_g]
            # the periods are the runs of bits
            pair, first, last = bit_runs(*presence(g, snap, code, op))
            value_code, source = pair % codes, heads[first]
            begin = snap_tx[first]
            k = np.flatnonzero(start != tx)
            if len(k):  # a run that begins with a carried assert begins where that one began
                k = k[np.argsort(snap[k] * codes + code[k], kind="stable")]
                keys = snap[k] * codes + code[k]
                at = np.minimum(np.searchsorted(keys, first * codes + value_code), len(keys) - 1)
                begin = np.where(keys[at] == first * codes + value_code, start[k][at], begin)
            open_end = last == group_end[first]
            finish = np.where(open_end, NEVER, snap_tx[np.minimum(last, n - 1)])
            held = None
            if not end:
                more = open_end & (e[source] == rest["e"][0].as_py()) & (a[source] == rest["a"][0].as_py()) & (block[source] == rest["block"][0].as_py())
                k = np.flatnonzero(more)
                top = int(tx[op == 0].max(initial=-(2**62), where=(g[op == 0] == g[-1]))) if len(k) else 0
                carry = pa.table(
                    {"e": e[source[k]], "a": a[source[k]], "v": words.take(pa.array(value_code[k])), "tx": np.full(len(k), top), "op": np.zeros(len(k), np.int8), "block": block[source[k]], "start": begin[k]}
                )
                held = pa.concat_tables([carry.cast(rest.select(carry.column_names).schema), rest.select(carry.column_names)])
                done = np.flatnonzero(~more)
                source, value_code, begin, finish, open_end = source[done], value_code[done], begin[done], finish[done], open_end[done]
            b = block[source].astype(np.int64)
            value = words.take(pa.array(value_code))
            if edges and (b > 0).any():  # keep to the block
                lows = np.array([-(2**63), *edges], np.int64)
                highs = np.array([*edges, 2**63 - 1], np.int64)
                k = np.maximum(b, 1) - 1
                low, high = np.where(b > 0, lows[k], -(2**63)), np.where(b > 0, highs[k], 2**63 - 1)
                inside = (open_end | (finish > low)) & ~((b > 0) & (begin >= high))
                left = (b > 1) & (begin < low)
                right = (b > 0) & (b <= len(edges)) & open_end
                begin = np.where(left, low, begin)
                finish = np.where(right, high, finish)
                cols = [x[inside] for x in (e[source], a[source])] + [value.filter(pa.array(inside))] + [x[inside] for x in (begin, finish, b.astype(np.int32), left, right)]
            else:
                none = np.zeros(len(b), bool)
                cols = [e[source], a[source], value, begin, finish, b.astype(np.int32), none, none]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in cols], ["e", "a", "v", "from_tx", "to_tx", "block", "left", "right"])

    return run


def history(changes: DataFrame, share: float | None = None, blocks: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(e, a, v, from_tx, to_tx): the maximal periods in which one-valued (e, a) holds v without a break.

    ``changes`` are facts of one-valued attributes (e, a, v, tx, op). to_tx is the first tx at which v
    no longer holds, -1 if it holds at the end. Repeated rows change nothing; two values asserted by
    one tx have a period each; an assert and a retract of a value in one tx leave it asserted. Rows
    with a null are left out; an empty table gives no rows; other columns are ignored. ``keys`` (e, a, tx)
    may stand for the changes where it is only asked which keys are hot and how they are cut; it may have
    rows that are no changes.
    """
    rows = changes.select("e", "a", "v", "tx", F.col("op").cast("tinyint").alias("op")).dropna()
    hot, edges = timeline.plan([keys if keys is not None else rows], share, blocks)
    hot = hot[0]
    key = [*timeline.KEY, "block"]

    def pieces(part: DataFrame) -> DataFrame:
        return part.repartition(*key).sortWithinPartitions(*key, "tx").mapInArrow(_periods(edges), _OUT)

    whole = pieces(rows.where(~is_hot(timeline.KEY, hot)).withColumn("block", F.lit(0))).select("e", "a", "v", "from_tx", "to_tx")
    if not hot:
        return whole
    return whole.unionByName(_joined(pieces(timeline.blocked(rows.where(is_hot(timeline.KEY, hot)), hot, edges))))


def _joined(pieces: DataFrame) -> DataFrame:
    """Joins the pieces of hot groups that touch at the edges of their blocks.

    Only pieces that touch an edge, at most a few for each hot group and block, are brought together.
    """
    touch = F.col("left") | F.col("right")
    pieces = pieces.withColumn("lone", F.when(touch, F.lit(0)).otherwise(F.xxhash64("from_tx", "v")))
    w = Window.partitionBy("e", "a", "lone", F.when(touch, F.col("v")))
    order = w.orderBy("from_tx", "block")
    new = ~(F.col("left") & (F.lag("to_tx").over(order) == F.col("from_tx"))) | F.lag("to_tx").over(order).isNull()
    pieces = pieces.withColumn("new", F.when(touch, new).otherwise(F.lit(True)).cast("int"))
    pieces = pieces.withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        pieces.groupBy("e", "a", "lone", F.when(touch, F.col("v")).alias("w"), "n", F.when(~touch, F.struct("from_tx", "v")).alias("own"))
        .agg(F.first("v").alias("v"), F.min("from_tx").alias("from_tx"), F.max(F.struct("block", "to_tx")).alias("t"))
        .select("e", "a", "v", "from_tx", F.col("t.to_tx").alias("to_tx"))
    )


def log_history(datoms: DataFrame, attrs: DataFrame, above: int = 6) -> DataFrame:
    """``history`` of all one-valued attributes with an id above ``above``."""
    changes = facts(datoms, attrs).where((F.col("card") == ONE) & (F.col("a") > above))
    return history(changes, keys=keys_of(datoms, attrs, ONE).where(F.col("a") > above))
