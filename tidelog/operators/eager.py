"""Totals by key where a few keys hold most rows: eager aggregation through a join.

Both inputs are reduced by join key first; the join sees compact states only, and counts are combined
algebraically after it. No shuffle is by the hot key alone before map-side aggregation has made its
rows few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.facts import value_text
from tidelog.operators.skew import hot_keys, is_hot


def attribute_totals(datoms: DataFrame, attrs: DataFrame, share: float | None = None) -> DataFrame:
    """(a, n_facts, n_entities, first_tx, last_tx) for each attribute that has a fact.

    A fact is a distinct row of a declared attribute in the declared type, assert or retract. Repeats
    count once. A null e is no entity, a null tx takes no part in first_tx and last_tx; rows with a
    null a, and attributes without a declaration or a fact, give no row. Repeated declarations count
    once; if an attribute is declared with two types, facts of both count.

    Rows move once, by (a, e): repeats are removed, and rows counted per (a, type, e), where they meet.
    Those of an (a, e) with a large share meet by all their columns instead (an even spread whatever the
    keys), and are counted per (a, type, e) before they move again. What then moves is one count per task
    and (a, type). The state that is joined has one row per (a, type); so has the one of the declarations.
    """
    whole, key = ["a", "vt", "e", "v", "tx", "op"], ["a", "e"]
    rows = datoms.where(F.col("a").isNotNull() & F.col("vt").isNotNull())
    hot = is_hot(key, hot_keys(rows.select(*key), key, share))
    rows = rows.select("a", "vt", "e", value_text().alias("v"), "tx", "op")

    def by_entity(once: DataFrame) -> DataFrame:
        return once.groupBy("a", "vt", "e").agg(F.count(F.lit(1)).alias("n"), F.min("tx").alias("lo"), F.max("tx").alias("hi"))

    cold = by_entity(rows.where(~hot).repartition(*key).groupBy(*whole).agg(F.lit(1).alias("one")))
    counts = cold.unionByName(by_entity(rows.where(hot).groupBy(*whole).agg(F.lit(1).alias("one"))))
    left = counts.groupBy("a", "vt").agg(F.sum("n").alias("n"), F.count("e").alias("ne"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    right = attrs.groupBy(F.col("id").alias("a"), F.col("value_type").alias("vt")).agg(F.count(F.lit(1)).alias("declared"))
    return (
        left.join(right, ["a", "vt"])
        .groupBy("a")
        .agg(F.sum("n").alias("n_facts"), F.sum("ne").alias("n_entities"), F.min("lo").alias("first_tx"), F.max("hi").alias("last_tx"))
    )


def joined_counts(left: DataFrame, right: DataFrame, key: str, by: str, measure: str) -> DataFrame:
    """``left`` joined with ``right`` on ``key``: rows and sum of left's ``measure`` for each ``by`` of right.

    Equal to joining all rows and grouping by ``by``, but the join sees one row per key of the left
    and one per (key, by) of the right: pair counts are products of counts, sums are multiplied by
    the other side's count. Null keys meet nothing; a null ``by`` is a group; null measures add 0 to
    a sum that is null only if all are. Products are decimals of 38 digits, as pairs outgrow 64 bits.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    few = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("s"))
    other = right.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k"), F.col(by).alias("by")).agg(F.count(F.lit(1)).alias("m"))
    return few.join(other, "k").groupBy(F.col("by").alias(by)).agg(F.sum(wide("n") * wide("m")).alias("rows"), F.sum(wide("s") * wide("m")).alias("total"))
