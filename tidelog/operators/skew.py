"""Finding keys that hold a large share of a table, in one pass and bounded memory; no summary of all tasks meets in one."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, or from one shuffle partition's share if that is less.
HOT_SHARE = 1 / 400
#: Counters of a summary at least, and for each key that can be hot; counts are too high by at most about 3.5/counters of all rows.
TRACKED, TRACKED_A_KEY = 10_000, 8
#: Spark's own limit to the counters of a summary: from 125,000 shuffle partitions on there are fewer for each key.
MOST_TRACKED = 1_000_000


def key_hash(cols: Sequence[str | Column]) -> Column:
    return F.xxhash64(*cols)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_share(df: DataFrame) -> float:
    """HOT_SHARE, or the share of one shuffle partition where there are more of them."""
    return min(HOT_SHARE, 1 / partitions(df))


def _group(df: DataFrame) -> Column:
    """A number for a group of about as many map tasks as there are groups: summaries are merged by group first."""
    return F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(partitions(df))))).alias("part")


def all_hot_keys(dfs: Sequence[DataFrame], cols: Sequence[str | Column], share: float | None = None) -> list[list[int]]:
    """For each table the hashes of the keys that hold more than ``share`` (by default hot_share) of its rows, from one job.

    Each task makes a summary of its rows; summaries meet in groups of tasks, and only the groups' in
    one task. A summary's counts are never too low, so it misses none; a key a little under the share may
    be named as well, which costs callers nothing but a detour. A list has at most about 1/share entries,
    no more than shuffle partitions, at any table size, so it may be put into a plan as a constant. An
    empty table gives an empty list.
    """
    share = share or hot_share(dfs[0])
    most = min(math.ceil(1 / share), MOST_TRACKED)
    rows = reduce(DataFrame.unionAll, [df.select(F.lit(i).alias("side"), key_hash(cols).alias("k")) for i, df in enumerate(dfs)])
    counters = min(max(TRACKED, TRACKED_A_KEY * most), MOST_TRACKED)
    of_group = rows.groupBy("side", _group(rows)).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(k, {counters})").alias("s"))
    whole = of_group.groupBy("side").agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(s, {counters})").alias("s"))
    got = {r.side: r for r in whole.select("side", "n", F.expr(f"approx_top_k_estimate(s, {most})").alias("top")).collect()}
    return [sorted(x.item for x in got[i].top or [] if x["count"] > share * got[i].n) if i in got else [] for i in range(len(dfs))]


def hot_keys(df: DataFrame, cols: Sequence[str | Column], share: float | None = None) -> list[int]:
    """all_hot_keys of one table."""
    return all_hot_keys([df], cols, share)[0]


def is_hot(cols: Sequence[str], hot: Sequence[int]) -> Column:
    """Whether the row's key is one of ``hot``; a long list becomes a set that is made once, not an expression for each."""
    if len(hot) <= 50:
        return key_hash(cols).isin(list(hot)) if hot else F.lit(False)
    names = ", ".join(f"`{c}`" for c in cols)
    return F.expr(f"xxhash64({names}) in ({', '.join(f'{x}L' for x in hot)})")


def quantile_edges(df: DataFrame, col: str, parts: int) -> list[int]:
    """Inner edges, at most parts-1 and ascending, that cut ``col`` into about equal shares.

    Each group of tasks gives quantiles of its rows, with their number as weight; the quantiles of those
    are taken in one task.
    """
    points = [(i + 0.5) / (2 * parts) for i in range(2 * parts)]
    array = lambda xs: F.from_json(F.lit(json.dumps(list(xs))), "array<double>")
    of_group = df.where(F.col(col).isNotNull()).groupBy(_group(df)).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(col, array(points), F.lit(max(1_000, 4 * parts))).alias("q"))
    few = of_group.select("n", F.explode("q").alias("x"))
    got = few.agg(F.percentile("x", array(i / parts for i in range(1, parts)), F.col("n")).alias("q")).first()[0] if parts > 1 else []
    return sorted({math.ceil(x) for x in got or []})


def _numbers(xs: Sequence) -> Column:
    """A constant array, or array of arrays, of longs; the optimizer makes one literal of it."""
    return F.from_json(F.lit(json.dumps(xs)), "array<array<bigint>>" if xs and isinstance(xs[0], list) else "array<bigint>")


def block_of(col: str | Column, edges: Sequence[int]) -> Column:
    """Number of edges that are less than or equal to the value, 0 to len(edges).

    Many edges are looked through in two steps, first every so many-th one, then those after it.
    """
    c = F.col(col) if isinstance(col, str) else col
    if not edges:
        return F.lit(0)
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= c))
    edges = list(edges)
    if len(edges) <= 64:
        return below(_numbers(edges))
    step = math.isqrt(len(edges))
    part = below(_numbers(edges[step::step]))
    return part * step + below(F.get(_numbers([edges[i : i + step] for i in range(0, len(edges), step)]), part))
