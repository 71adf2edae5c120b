"""Facts of a log of datoms, and which of them hold at its end.

Columns used: e, a, vt, v_i64, v_u64, v_dec, v_str, v_ref, tx, op; others are ignored. Within this
package a value travels as text (``v``), which is exact: all facts of an attribute are of its one
declared type, and equal values of a type have equal text.

* Rows without e, a, tx or op, or without a value in their lane, are no facts.
* Repeated rows change nothing.
* A retract in the very transaction of an assert does not end it.
* Two values asserted by the same, latest, transaction of a one-valued attribute both hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.skew import hot_keys, is_hot

LANES = {1: "v_i64", 2: "v_u64", 3: "v_dec", 4: "v_str", 5: "v_ref"}
ONE, MANY = 0, 1


def value_text(vt: str = "vt") -> Column:
    """The value of a row as text: strings as they are, numbers in decimal digits."""
    c = F.when(F.col(vt) == 4, F.col("v_str"))
    for tag, lane in LANES.items():
        if tag != 4:
            c = c.when(F.col(vt) == tag, F.col(lane).cast("string"))
    return c


def declared(attrs: DataFrame) -> DataFrame:
    """One row (a, decl, card) for each declared attribute id; of contradicting rows, the greatest."""
    return (
        attrs.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("a"))
        .agg(F.max(F.struct(F.col("value_type").alias("decl"), F.col("card").alias("card"))).alias("d"))
        .select("a", "d.decl", "d.card")
    )


def facts(datoms: DataFrame, attrs: DataFrame, only: Sequence[int] | None = None) -> DataFrame:
    """(e, a, v, tx, op, card, decl) of all facts, repeats included.

    ``attrs`` is joined by attribute id; it has one row per attribute, and Spark broadcasts it only
    while its measured size is under the session's threshold. ``only`` restricts the attributes and
    reaches the scan as a pushed filter.
    """
    if only is not None:
        datoms = datoms.where(F.col("a").isin([int(x) for x in only]))
    rows = datoms.select("e", "a", "vt", value_text().alias("v"), "tx", "op")
    return (
        rows.join(declared(attrs), "a")
        .where((F.col("vt") == F.col("decl")) & F.col("v").isNotNull() & F.col("e").isNotNull() & F.col("tx").isNotNull() & F.col("op").isNotNull())
        .select("e", "a", "v", "tx", "op", "card", "decl")
    )


def keys_of(datoms: DataFrame, attrs: DataFrame, card: int) -> DataFrame:
    """(e, a, tx) of the rows of attributes of a cardinality, facts or not: what is read to see which keys are hot."""
    return datoms.select("e", "a", "tx").join(declared(attrs).where(F.col("card") == card).select("a"), "a", "left_semi").select("e", "a", "tx")


def states(rows: DataFrame, hot: Sequence[int] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """One row (e, a, v, card, decl, la, lr, fa, top, holds) for each (e, a, v) of the facts ``rows``.

    la and fa are the latest and first asserting tx, lr the latest retracting one; top says that no
    later assert replaced it, holds that moreover no later retract ended it.

    One shuffle by (e, a). Those that hold a large share of the rows take another way: map-side
    aggregates by value, and the latest assert of each such (e, a) broadcast (see hot_keys for how many
    there can be), so that no task receives one whole. ``keys`` (e, a) may stand for the rows where it is
    only asked which keys are hot; it may have rows that are no facts.
    """
    key = ["e", "a"]
    if hot is None:
        hot = hot_keys(keys if keys is not None else rows, key)
    agg = [
        F.max(F.when(F.col("op") == 0, F.col("tx"))).alias("la"),
        F.max(F.when(F.col("op") == 1, F.col("tx"))).alias("lr"),
        F.min(F.when(F.col("op") == 0, F.col("tx"))).alias("fa"),
    ]
    by = [*key, "v", "card", "decl"]
    cold = rows.where(~is_hot(key, hot)).repartition(*key).groupBy(*by).agg(*agg)
    cold = cold.withColumn("m", F.max("la").over(Window.partitionBy(*key)))
    if hot:
        some = rows.where(is_hot(key, hot))
        last = some.where(F.col("op") == 0).groupBy(*key).agg(F.max("tx").alias("m"))
        cold = cold.unionByName(some.groupBy(*by).agg(*agg).join(F.broadcast(last), key, "left"))  # at most one row per hot key
    top = F.col("la").isNotNull() & ((F.col("card") == MANY) | (F.col("la") == F.col("m")))
    return cold.select("e", "a", "v", "card", "decl", "la", "lr", "fa", top.alias("top"), (top & (F.col("lr").isNull() | (F.col("lr") <= F.col("la")))).alias("holds"))
