"""Transactions: entity operations to datoms, with types, uniqueness and cardinality."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.values import ASSERT, LANES, LOG_SCHEMA, REF_TAG, RETRACT, Value, datom, declared, ref, u64, value_of
from tidelog.sources.log import DatomLog, visible
from tidelog.session import cut_lineage
from tidelog.sources.schema import ONE, TX_TIME, AttributeDefinition, IdentNotFound


class TransactionError(Exception):
    """A transaction that is refused; the log stays as it was."""


class InvalidAttributeType(TransactionError):
    pass


class DuplicateTempId(TransactionError):
    pass


class TempIdNotFound(TransactionError):
    pass


class DuplicateUniqueValue(TransactionError):
    pass


class ResolveError(TransactionError):
    pass


@dataclass(frozen=True)
class TempRef:
    """A value that is the entity of a temp id."""

    name: str


@dataclass
class EntityOperation:
    """What a transaction asserts and retracts about one entity: a new one, one by id, or one by temp id."""

    id: int | None = None
    temp_id: str | None = None
    changes: list[tuple[str, Any, int]] = field(default_factory=list)

    @classmethod
    def on_new(cls) -> EntityOperation:
        return cls()

    @classmethod
    def on_id(cls, id: int) -> EntityOperation:
        return cls(id=id)

    @classmethod
    def on_temp_id(cls, name: str) -> EntityOperation:
        return cls(temp_id=name)

    def assert_(self, attribute: str, value: Any) -> EntityOperation:
        self.changes.append((attribute, value, ASSERT))
        return self

    def retract(self, attribute: str, value: Any) -> EntityOperation:
        self.changes.append((attribute, value, RETRACT))
        return self

    def set_reference(self, attribute: str, temp_id: str) -> EntityOperation:
        return self.assert_(attribute, TempRef(temp_id))


class Transaction:
    def __init__(self) -> None:
        self.operations: list[EntityOperation] = []

    def with_(self, what: EntityOperation | AttributeDefinition) -> Transaction:
        if isinstance(what, AttributeDefinition):
            op = EntityOperation.on_new()
            for a, v in what.facts():
                op.assert_(a, v)
            what = op
        self.operations.append(what)
        return self


@dataclass(frozen=True)
class Result:
    tx_id: int
    tx_data: list[tuple]
    temp_ids: dict[str, int]


def transact(log: DatomLog, tx: Transaction, now: int | None = None, strict_unique: bool = False) -> Result:
    """The datoms of a transaction, not yet saved.

    Ids follow the log's greatest: first the transaction's, then those of temp ids in the order of
    operations, then those of new entities. Everything is judged by the log before the transaction,
    temp ids and uniqueness within the transaction aside. A one-valued attribute that is touched, by a
    retract as well, has all its current values retracted, even if one is asserted again; two values
    asserted in one transaction both stay; a change that is given twice is one. A unique value may be retracted, and asserted again for the
    entity that has it; ``strict_unique`` refuses both.
    """
    next_id = log.latest_entity_id()
    catalog = log.catalog()

    def new_id() -> int:
        nonlocal next_id
        next_id += 1
        return next_id

    tx_id = new_id()
    rows = [datom(tx_id, TX_TIME, u64(int(time.time()) if now is None else now), tx_id)]
    temp_ids: dict[str, int] = {}
    for op in tx.operations:
        if op.temp_id is not None:
            if op.temp_id in temp_ids:
                raise DuplicateTempId(op.temp_id)
            temp_ids[op.temp_id] = new_id()
    facts: list[tuple[int, Any, Value, int]] = []
    for op in tx.operations:
        e = op.id if op.id is not None else temp_ids[op.temp_id] if op.temp_id is not None else new_id()
        for ident, x, kind in op.changes:
            try:
                a = catalog.resolve(ident)
            except IdentNotFound as error:
                raise ResolveError(ident) from error
            if isinstance(x, TempRef):
                if x.name not in temp_ids:
                    raise TempIdNotFound(x.name)
                x = ref(temp_ids[x.name])
            v = declared(x, a.type)
            if v.tag != a.type:
                raise InvalidAttributeType(f"{ident} takes no {v}")
            facts.append((e, a, v, kind))
    _check_unique(log, facts, strict_unique)
    touched = {(e, a.id) for e, a, _, _ in facts if a.card == ONE}
    old: dict[tuple[int, int], list[tuple]] = {}
    if touched:
        for r in log.rows_of({e for e, _ in touched}, {a for _, a in touched}):
            old.setdefault((r[0], r[1]), []).append(r)
    rows += [datom(e, a.id, v, tx_id, kind) for e, a, v, kind in facts]
    given = {r[:8] for r in rows if r[9] == RETRACT}
    for key in dict.fromkeys((e, a.id) for e, a, _, _ in facts if (e, a.id) in touched):
        rows += [r[:8] + (tx_id, RETRACT) for r in dict.fromkeys(r[:8] for r in old.get(key, [])) if r not in given]
    return Result(tx_id, list(dict.fromkeys(rows)), temp_ids)


def _check_unique(log: DatomLog, facts: list[tuple], strict: bool) -> None:
    within: set[tuple[int, Value]] = set()
    asked: dict[int, set[Value]] = {}
    for _, a, v, kind in facts:
        if a.unique and (kind == ASSERT or strict):
            if (a.id, v) in within:
                raise DuplicateUniqueValue(f"{a.ident} {v}")
            within.add((a.id, v))
            asked.setdefault(a.id, set()).add(v)
    for a, values in asked.items():
        holders: dict[Value, set[int]] = {}
        for r in log.holders(a, values):
            holders.setdefault(value_of(r), set()).add(r[0])
        for e, b, v, kind in facts:
            others = holders.get(v, set()) - (set() if strict else {e})
            if b.id == a and others and (kind == ASSERT or strict):
                raise DuplicateUniqueValue(f"{b.ident} {v}")


class Connection:
    """A log with its transactions applied; one writer."""

    def __init__(self, log: DatomLog, clock: Callable[[], int] | None = None):
        self.log, self.clock, self.last_tx = log, clock or (lambda: int(time.time())), 0

    def transact(self, tx: Transaction, **how: Any) -> Result:
        result = transact(self.log, tx, self.clock(), **how)
        self.log.save(result.tx_data)
        self.last_tx = result.tx_id
        return result


OPERATIONS = "op_no long, entity_kind string, entity_id long, temp_id string, attr string, vt tinyint, v_i64 long, v_u64 decimal(20,0), v_dec decimal(38,18), v_str string, v_ref long, ref_temp_id string, op tinyint"


#: The rules that operations can break, in the order in which they are judged.
RULES: list[tuple[str, type[TransactionError]]] = [
    ("name", ResolveError), ("temp id twice", DuplicateTempId), ("temp id missing", TempIdNotFound), ("type", InvalidAttributeType), ("unique in transaction", DuplicateUniqueValue), ("unique in log", DuplicateUniqueValue),
]


@dataclass(frozen=True)
class Resolved:
    """Operations with their entities, attributes and references as ids, and the new temp ids (temp_id, id)."""

    tx: int
    rows: DataFrame
    temp_ids: DataFrame


def resolve_operations(log: DatomLog, operations: DataFrame) -> Resolved:
    """Gives ids to new entities and temp ids; judges nothing yet.

    The rows are written to the checkpoint folder, so that what is judged is what is returned, and worked
    out once.

    The rows have op_no, e, a, the value, tx, op, attr, decl, card, uniq, temp_id and ref_temp_id; an
    unknown name has no a, an unknown temp id gives no v_ref.
    """
    spark = operations.sparkSession
    catalog = log.catalog()
    known = spark.createDataFrame([(x.ident, x.id, x.type, x.card, x.unique) for x in catalog.by_ident.values()], "attr string, a long, decl int, card int, uniq boolean")
    tx = log.latest_entity_id() + 1
    temps = operations.where(F.col("entity_kind") == "temp_id").groupBy("temp_id").agg(F.min("op_no").alias("op_no"))
    new = operations.where(F.col("entity_kind") == "new").select(F.lit(1).alias("last"), "op_no", F.lit(None).cast("string").alias("temp_id")).distinct()
    made = temps.select(F.lit(0).alias("last"), "op_no", "temp_id").unionByName(new)
    made = _numbered(made, ["last", "op_no"], tx + 1)
    ids = made.where(F.col("last") == 0).select("temp_id", F.col("n").alias("id"))
    news = made.where(F.col("last") == 1).select("op_no", F.col("n").alias("new_id"))
    ops = operations.join(known, "attr", "left")  # Spark broadcasts the catalog while it is under the session's threshold
    ops = ops.join(ids.withColumnRenamed("id", "temp_e"), "temp_id", "left").join(news, "op_no", "left")
    ops = ops.join(ids.select(F.col("temp_id").alias("ref_temp_id"), F.col("id").alias("ref_e")), "ref_temp_id", "left")
    by_name = F.col("ref_temp_id").isNotNull()
    e = F.when(F.col("entity_kind") == "id", F.col("entity_id")).when(F.col("entity_kind") == "temp_id", F.col("temp_e")).otherwise(F.col("new_id"))
    rows = ops.select(
        "op_no", e.alias("e"), "a", F.when(by_name, F.lit(REF_TAG)).otherwise(F.col("vt")).cast("tinyint").alias("vt"), "v_i64", "v_u64", "v_dec", "v_str", F.when(by_name, F.col("ref_e")).otherwise(F.col("v_ref")).alias("v_ref"),
        F.lit(tx).cast("long").alias("tx"), F.col("op").cast("tinyint").alias("op"), "attr", "decl", "card", "uniq", F.when(F.col("entity_kind") == "temp_id", F.col("temp_id")).alias("temp_id"), "ref_temp_id",
    )
    return Resolved(tx, cut_lineage(rows), ids)


def violations(log: DatomLog, resolved: Resolved) -> DataFrame:
    """(rule, op_no, what): each operation that breaks a rule of RULES, with the name or temp id that does.

    An operation may break several. A value that is given twice for a unique attribute refuses both
    operations, also if they are the same.
    """
    rows = resolved.rows
    out = []

    def broken(rule: str, bad: DataFrame, what: str = "attr") -> None:
        out.append(bad.select(F.lit(rule).alias("rule"), "op_no", F.col(what).alias("what")))

    broken("name", rows.where(F.col("a").isNull()))
    twice = rows.where(F.col("temp_id").isNotNull()).groupBy("temp_id").agg(F.min("op_no").alias("x"), F.max("op_no").alias("y")).where("x <> y").select("temp_id")
    broken("temp id twice", rows.join(twice, "temp_id", "left_semi"), "temp_id")
    broken("temp id missing", rows.where(F.col("ref_temp_id").isNotNull() & F.col("v_ref").isNull()), "ref_temp_id")
    broken("type", rows.where(F.col("vt") != F.col("decl")))
    lanes = ["a", "vt", *LANES.values()]
    unique = rows.where(F.col("uniq") & (F.col("op") == ASSERT)).select("op_no", "e", "attr", F.struct(*lanes).alias("fact"))
    # one row for each value, so that no copy meets every other one
    often = unique.groupBy("fact").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fact")
    broken("unique in transaction", unique.join(often, "fact", "left_semi"))
    of = [x.id for x in log.catalog().by_id.values() if x.unique]
    held = visible(log.frame(), None, F.col("a").isin(of), log.has_retracts(None), log.is_set()).groupBy(F.struct(*lanes).alias("fact")).agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    broken("unique in log", unique.join(held, "fact").where((F.col("lo") != F.col("e")) | (F.col("hi") != F.col("e"))))
    return reduce(DataFrame.unionByName, out).distinct()


def bulk_transact(log: DatomLog, operations: DataFrame, now: int) -> tuple[int, DataFrame, DataFrame]:
    """One transaction of any size: (tx id, its datoms, temp ids) from a table of operations (see OPERATIONS).

    Rows with the same op_no speak about one entity: by id, by temp id, or a new one. The rules are those
    of ``transact``; whatever breaks one raises and leaves the log as it was. All steps are joins and
    aggregates; only the catalog, the transaction's id and up to three offenders come to the driver.
    """
    resolved = resolve_operations(log, operations)
    number = F.create_map(*[F.lit(x) for i, (rule, _) in enumerate(RULES) for x in (rule, i)])[F.col("rule")]
    bad = violations(log, resolved).orderBy(number, "op_no").limit(3).collect()
    if bad:
        raise dict(RULES)[bad[0].rule](", ".join(str(r.what) for r in bad if r.rule == bad[0].rule))
    return resolved.tx, datoms_of(log, resolved, now), resolved.temp_ids


def datoms_of(log: DatomLog, resolved: Resolved, now: int) -> DataFrame:
    """The datoms of operations that break no rule: what they say, the retracts of what they replace, and the transaction's time."""
    rows, tx, spark = resolved.rows, resolved.tx, resolved.rows.sparkSession
    touched = rows.where(F.col("card") == ONE).select("e", "a").distinct()
    one = [x.id for x in log.catalog().by_id.values() if x.card == ONE]
    ended = visible(log.frame(), None, F.col("a").isin(one), log.has_retracts(None), log.is_set()).join(touched, ["e", "a"], "left_semi")
    ended = ended.withColumn("tx", F.lit(tx).cast("long")).withColumn("op", F.lit(RETRACT).cast("tinyint"))
    time_row = spark.createDataFrame([datom(tx, TX_TIME, u64(now), tx)], LOG_SCHEMA)
    names = LOG_SCHEMA.names
    return rows.select(*names).unionByName(ended.select(*names)).unionByName(time_row).distinct()


def _numbered(df: DataFrame, order: list[str], start: int) -> DataFrame:
    """``df`` with n = start, start+1, ... in the given order, without bringing all rows to one task.

    Rows are numbered within range partitions and written; the partitions' counts, one row each, give
    every partition its offset.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("_p", T.IntegerType()), T.StructField("_i", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())], schema.names)
            at += b.num_rows

    parts = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema))
    before = F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_o", F.coalesce(before, F.lit(0)))
    return parts.join(F.broadcast(offsets.select("_p", "_o")), "_p").select(*names, (F.col("_o") + F.col("_i") + start).alias("n"))
