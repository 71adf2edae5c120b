"""Entity-attribute-value rows to one wide row per entity with typed columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.facts import MANY, facts, states

#: Attributes of one aggregation; more are aggregated in several and joined by entity.
AT_ONCE = 1_000
SQL_TYPES = {1: "bigint", 2: "decimal(20,0)", 3: "decimal(38,18)", 4: "string", 5: "bigint"}


@dataclass(frozen=True)
class Attribute:
    id: int
    ident: str
    type: int
    card: int


def discover(attrs: DataFrame, prefix: str) -> list[Attribute]:
    """The declared attributes whose ident begins with ``prefix``, by id; they become part of the plan.

    Of contradicting declarations of an id the one with the greatest type, then cardinality, then ident
    counts, as in facts.declared.
    """
    some = attrs.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("value_type", "card", "ident")).alias("d"))
    found = some.where(F.col("d.ident").startswith(prefix)).select("id", "d.ident", "d.value_type", "d.card").orderBy("id").collect()
    return [Attribute(*r) for r in found]


def column_name(ident: str) -> str:
    return ident.replace("/", "_").replace("-", "_")


def one_value(a: Attribute) -> Column:
    """The value of a one-valued attribute: of the latest assert, of several in one tx the greatest."""
    typed = F.col("v").cast(SQL_TYPES[a.type])
    return F.max(F.when(F.col("a") == a.id, F.struct(F.col("la").alias("la"), typed.alias("x"))))["x"]


def n_values(a: Attribute) -> Column:
    return F.count(F.when(F.col("a") == a.id, F.lit(1)))


def widen(held: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """One row per e of ``held`` (e, a, v, la), one column per attribute.

    One-valued attributes give a column of their type, null if there is no value; many-valued ones
    the number of distinct values, 0 if there is none. All columns come from one aggregation, or from one
    for each AT_ONCE attributes, whose results are joined by entity.
    """
    cols = [(n_values(a) if a.card == MANY else one_value(a)).alias(column_name(a.ident)) for a in attributes]
    if len(cols) <= AT_ONCE:
        return held.groupBy("e").agg(*cols) if cols else held.select("e").distinct()
    out = held.select("e").distinct()
    for i in range(0, len(cols), AT_ONCE):
        some = attributes[i : i + AT_ONCE]
        part = held.where(F.col("a").isin([a.id for a in some])).groupBy("e").agg(*cols[i : i + AT_ONCE])
        out = out.join(part, "e", "left").fillna(0, [column_name(a.ident) for a in some if a.card == MANY])
    return out


def wide_entities(datoms: DataFrame, attrs: DataFrame, prefix: str) -> tuple[DataFrame, list[Attribute]]:
    """Entities with a fact of any attribute under ``prefix`` holding at the end, and the attributes.

    Repeated rows change nothing; entities whose facts have all ended give no row; no attribute or no
    fact gives an empty table.
    """
    attributes = discover(attrs, prefix)
    ids = [a.id for a in attributes]
    held = states(facts(datoms, attrs, ids), keys=datoms.where(F.col("a").isin(ids)).select("e", "a")).where("holds")
    return widen(held, attributes), attributes


def movies(datoms: DataFrame, attrs: DataFrame) -> DataFrame:
    """(e, movie_name, movie_year, gross_cents, producer_e, n_cast) of each movie."""
    wide, attributes = wide_entities(datoms, attrs, "movie/")
    have = {column_name(a.ident) for a in attributes}

    def col(name: str, to: str, least: object, times: int = 1) -> Column:
        if name not in have:
            return F.lit(least).cast(to)
        c = F.col(name) * times if times != 1 else F.col(name)
        return F.coalesce(c.cast(to), F.lit(least).cast(to))

    return wide.select(
        "e",
        col("movie_name", "string", "").alias("movie_name"),
        col("movie_year", "bigint", -1).alias("movie_year"),
        col("movie_gross", "bigint", -1, 100).alias("gross_cents"),
        col("movie_producer", "bigint", -1).alias("producer_e"),
        col("movie_cast", "bigint", 0).alias("n_cast"),
    )
