"""Tables seen as facts without being copied.

A column of a table is an attribute, a row an entity, a cell a fact asserted at one import transaction;
a null cell is no fact. Entities of a table with an integer key are numbered exactly: the table's number
in the upper bits, the key below. Rows of a table without one are numbered by a hash of all their
columns, which may collide; queries that only go through such entities never compute it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import values as V
from tidelog.operators.skew import block_of, hot_keys, is_hot, partitions, quantile_edges
from tidelog.sources.schema import ONE, Attribute, AttributeDefinition

KEY_BITS = 48
_FIRST_ATTRIBUTE = 1_000


def entity_id(table: int, key: Column) -> Column:
    return F.lit(table << KEY_BITS).cast("long") + key.cast("long")


@dataclass(frozen=True)
class Field:
    """An attribute of a table: its name, column, type, and for a reference the number of its table."""

    ident: str
    column: str
    type: int
    to: int | None = None


@dataclass(frozen=True, eq=False)
class VirtualTable:
    number: int
    frame: DataFrame
    key: str | None
    fields: tuple[Field, ...]
    import_tx: int = 7

    def attribute_id(self, i: int) -> int:
        return _FIRST_ATTRIBUTE * (self.number + 1) + i

    def attributes(self) -> list[Attribute]:
        return [Attribute(self.attribute_id(i), f.ident, f.type, ONE, False, self.import_tx) for i, f in enumerate(self.fields)]

    def emptied(self) -> VirtualTable:
        return replace(self, frame=self.frame.limit(0))

    def entity(self) -> Column:
        if self.key is not None:
            return entity_id(self.number, F.col(self.key))
        row = F.xxhash64(*[F.col(c) for c in self.frame.columns])
        return entity_id(self.number, row.bitwiseAND(F.lit((1 << KEY_BITS) - 1)))

    def value(self, a: Attribute) -> Column:
        f = self.fields[a.id - self.attribute_id(0)]
        c = F.col(f.column)
        if f.to is not None:
            return entity_id(f.to, c)
        kind = self.frame.schema[f.column].dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            return F.unix_micros(c.cast("timestamp"))
        return c.cast(V.LANE_TYPES[f.type])

    def cells(self) -> DataFrame:
        """All facts of the table in the log's schema, from one scan."""
        one = lambda a: F.struct(F.lit(a.id).cast("long").alias("a"), V.dynamic(a.type, self.value(a)).alias("v"))
        rows = self.frame.select(self.entity().alias("e"), F.explode(F.array(*map(one, self.attributes()))).alias("x"))
        rows = rows.select("e", "x.a", "x.v.*", F.lit(self.import_tx).cast("long").alias("tx"), F.lit(V.ASSERT).cast("tinyint").alias("op"))
        return rows.where(F.coalesce(*[F.when(F.col(c).isNotNull(), 1) for c in V.LANES.values()]).isNotNull())

    def schema_rows(self) -> list[tuple]:
        """The attributes as datoms."""
        names = {"db/attr/ident": 1, "db/attr/cardinality": 2, "db/attr/type": 3}
        return [V.datom(a.id, names[n], v, self.import_tx) for a in self.attributes() for n, v in AttributeDefinition(a.ident, a.type).facts()]

    def check_unique(self) -> None:
        """Raises if two rows have one entity id."""
        bad = self.frame.groupBy(self.entity().alias("e")).count().where("count > 1").limit(1).collect()
        if bad:
            raise ValueError(f"rows of table {self.number} share entity {bad[0].e}")


#: number, table, key, then ident, column, type and for references the table they go to
_STAR = [
    (1, "region", "r_regionkey", [("region/name", "r_name", V.STR)]),
    (2, "nation", "n_nationkey", [("nation/name", "n_name", V.STR), ("nation/region", "n_regionkey", V.REF_TAG, 1)]),
    (3, "customer", "c_custkey", [("customer/name", "c_name", V.STR), ("customer/nation", "c_nationkey", V.REF_TAG, 2), ("customer/acctbal", "c_acctbal", V.DECIMAL), ("customer/mktsegment", "c_mktsegment", V.STR)]),
    (4, "supplier", "s_suppkey", [("supplier/name", "s_name", V.STR), ("supplier/nation", "s_nationkey", V.REF_TAG, 2), ("supplier/acctbal", "s_acctbal", V.DECIMAL)]),
    (5, "part", "p_partkey", [("part/name", "p_name", V.STR), ("part/brand", "p_brand", V.STR), ("part/type", "p_type", V.STR), ("part/size", "p_size", V.I64), ("part/retailprice", "p_retailprice", V.DECIMAL)]),
    (6, "orders", "o_orderkey", [("order/customer", "o_custkey", V.REF_TAG, 3), ("order/status", "o_orderstatus", V.STR), ("order/totalprice", "o_totalprice", V.DECIMAL), ("order/date", "o_orderdate", V.I64), ("order/priority", "o_orderpriority", V.STR)]),
    (7, "lineitem", None, [("line/order", "l_orderkey", V.REF_TAG, 6), ("line/part", "l_partkey", V.REF_TAG, 5), ("line/supplier", "l_suppkey", V.REF_TAG, 4), ("line/number", "l_linenumber", V.I64), ("line/quantity", "l_quantity", V.I64), ("line/extendedprice", "l_extendedprice", V.DECIMAL), ("line/discount", "l_discount", V.DECIMAL), ("line/tax", "l_tax", V.DECIMAL), ("line/returnflag", "l_returnflag", V.STR), ("line/linestatus", "l_linestatus", V.STR), ("line/shipdate", "l_shipdate", V.I64)]),
    (8, "events", "event_id", [("event/ts", "ts", V.I64), ("event/user", "user_id", V.I64), ("event/type", "event_type", V.STR), ("event/value", "value", V.DECIMAL), ("event/props", "props", V.STR)]),
    (9, "documents", "doc_id", [("document/text", "text", V.STR), ("document/lang", "lang", V.STR), ("document/source", "source", V.STR), ("document/chars", "n_chars", V.I64)]),
    (10, "embeddings", "vec_id", [("embedding/label", "label", V.I64)]),
]


def star_tables(spark: SparkSession, d: str, names: Sequence[str]) -> list[VirtualTable]:
    """Virtual tables of the star schema in folder ``d``."""
    return [VirtualTable(n, spark.read.parquet(f"{d}/{t}.parquet"), key, tuple(Field(*f) for f in fields)) for n, t, key, fields in _STAR if t in names]


def keyed_history(rows: DataFrame, key: str, order: str, value: Column, attribute: Attribute) -> DataFrame:
    """A log of one one-valued attribute from a table of updates: ``value`` of entity ``key`` from tx ``order`` on.

    Each update retracts the one before it, as a transaction would; equal neighbouring values too.
    Rows with a null are left out.
    """
    rows = rows.select(F.col(key).cast("long").alias("e"), F.col(order).cast("long").alias("tx"), value.alias("x")).dropna()
    hot = hot_keys(rows, ["e"])
    edges = quantile_edges(rows.where(is_hot(["e"], hot)), "tx", partitions(rows)) if hot else []
    # entities with a large share of the updates are cut by tx; the last row of a piece goes on to the next piece's first
    rows = rows.withColumn("piece", F.when(is_hot(["e"], hot), block_of("tx", edges)).otherwise(F.lit(0)))
    rows = rows.withColumn("nxt", F.lead("tx").over(Window.partitionBy("e", "piece").orderBy("tx")))
    if edges:
        firsts = rows.where(is_hot(["e"], hot)).groupBy("e", "piece").agg(F.min("tx").alias("first"))
        firsts = firsts.withColumn("following", F.lead("first").over(Window.partitionBy("e").orderBy("piece"))).drop("first")
        rows = rows.join(firsts, ["e", "piece"], "left").withColumn("nxt", F.coalesce("nxt", "following"))
    both = rows.select("e", "x", F.explode(F.array(F.struct("tx", F.lit(0).alias("op")), F.struct(F.col("nxt").alias("tx"), F.lit(1).alias("op")))).alias("t"))
    both = both.where("t.tx is not null")
    return both.select("e", F.lit(attribute.id).cast("long").alias("a"), V.dynamic(attribute.type, F.col("x")).alias("v"), F.col("t.tx").alias("tx"), F.col("t.op").cast("tinyint").alias("op")).select("e", "a", "v.*", "tx", "op")
