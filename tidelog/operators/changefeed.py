"""Applying a feed of asserts, replacements and retracts: newest-first resolution.

The feed is worked through in batches from the newest tx to the oldest. Whatever a newer batch has
settled is taken out of the older ones by anti-joins, so each batch only adds first-seen images and
tombstones; rows of a base table that no batch has touched are appended in the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.facts import MANY, declared, states, value_text
from tidelog.operators.skew import hot_keys, quantile_edges
from tidelog.session import written

#: A batch is worked through in shuffle partitions like any table, so none has to fit anywhere; more of them only
#: find more of the older changes settled, and each costs a pass over the part of the feed with its tx.
BATCHES = 3
_SLOT = ["e", "a", "slot"]


def _slot():
    """What an assert settles: its (e, a) if one-valued, its (e, a, v) if many-valued."""
    return F.when(F.col("card") == MANY, F.concat(F.lit("="), F.col("v"))).otherwise(F.lit(""))


def resolve(feed: DataFrame, base: DataFrame | None = None, batches: int = BATCHES, edges: Sequence[int] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(e, a, v, card, tx): every value that holds after all changes, with its latest asserting tx.

    ``feed`` are facts (e, a, v, tx, op, card, decl) in any order; repeats change nothing, and delivery
    order has no influence. ``base`` (e, a, v, card, tx) is the state before the feed, all of whose tx
    are less than the feed's. Batches are cut at ``edges`` of tx, by default at quantiles; no tx is
    ever split, and the result does not depend on them. Of values asserted by one tx for a one-valued
    attribute all hold. An empty feed gives the base. ``keys`` (e, a, tx) may stand for the feed where keys
    are counted and edges are looked for; it may have rows that are no facts.
    """
    feed = feed.select("e", "a", "v", "tx", "op", "card", "decl")
    keys = feed if keys is None else keys
    if edges is None:
        edges = quantile_edges(keys.select("tx"), "tx", batches)
    hot = hot_keys(keys.select("e", "a"), ["e", "a"])
    bounds = [None, *edges, None]
    settled: DataFrame | None = None  # (e, a, slot, v, card, tx, mark): images, their slots, tombstones
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        part = feed
        if low is not None:
            part = part.where(F.col("tx") >= low)
        if high is not None:
            part = part.where(F.col("tx") < high)
        gone = F.col("lr").isNotNull() & (F.col("la").isNull() | (F.col("lr") > F.col("la")))
        # what its own batch has replaced already settles nothing
        now = states(part, hot).withColumn("slot", _slot()).withColumn("gone", gone).where(F.col("top") | F.col("gone"))
        if settled is not None:
            asserted = settled.where(F.col("mark") != "gone").select(*_SLOT).distinct()
            buried = settled.where(F.col("mark") == "gone").select("e", "a", "v").distinct().withColumn("buried", F.lit(True))
            now = now.join(asserted, _SLOT, "left_anti").join(buried, ["e", "a", "v"], "left")
            holds = F.col("holds") & F.col("buried").isNull()
        else:
            holds = F.col("holds")
        image = F.when(F.col("top") & holds, "image").when(F.col("top"), "ended").otherwise("gone")
        new = now.select("e", "a", "slot", "v", "card", F.col("la").alias("tx"), image.alias("mark"))
        # an assert that was ended also buries older asserts of its value, as its slot is settled
        new = written(new)
        settled = new if settled is None else settled.unionByName(new)
    images = settled.where(F.col("mark") == "image").select("e", "a", "v", "card", "tx")
    if base is None:
        return images
    rest = base.select("e", "a", "v", "card", "tx").withColumn("slot", _slot())
    asserted = settled.where(F.col("mark") != "gone").select(*_SLOT).distinct()
    buried = settled.where(F.col("mark") == "gone").select("e", "a", "v").distinct()
    rest = rest.join(asserted, _SLOT, "left_anti").join(buried, ["e", "a", "v"], "left_anti")
    return images.unionByName(rest.select("e", "a", "v", "card", "tx"))


def replica_facts(change_feed: DataFrame, attrs: DataFrame) -> DataFrame:
    """The rows of a feed as facts: all of them are, whatever type their attribute is declared with.

    Attributes without a declaration count as one-valued. Rows without e, a, tx, op or value are left out.
    """
    rows = change_feed.select("e", "a", F.col("vt").alias("decl"), value_text().alias("v"), "tx", "op").dropna()
    cards = declared(attrs).select("a", "card")
    return rows.join(cards, "a", "left").withColumn("card", F.coalesce("card", F.lit(0).cast("tinyint")))


def replica_state(change_feed: DataFrame, attrs: DataFrame) -> DataFrame:
    """(e, a, val, tx) of each value that holds at the end of the feed."""
    return resolve(replica_facts(change_feed, attrs), keys=change_feed).select("e", "a", F.col("v").alias("val"), "tx")
