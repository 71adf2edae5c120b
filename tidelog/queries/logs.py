"""Queries that write: logs in files and transactions, over whole tables, each with equivalent SQL.

Logs are written to folders of their own under the session's checkpoint folder, which all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import values as V
from tidelog.operators import transact as X
from tidelog.plans import edn
from tidelog.plans.planner import Database
from tidelog.plans.query import InvalidFindVariable, Query, count, total
from tidelog.session import checkpoint_dir, cut_lineage
from tidelog.sources.importer import star_tables
from tidelog.sources.log import DatomLog, FrameLog, ParquetLog
from tidelog.sources.schema import AttributeDefinition
from tidelog.streaming.ingest import append_to_log, datom_files

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _query(sql: str):
    def add(f):
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def _new_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, d: str) -> ParquetLog:
    """The table of datoms saved to files in two parts, some of it a second time."""
    datoms = spark.read.parquet(f"{d}/datoms.parquet")
    log = ParquetLog(spark, _new_path(spark), bootstrap=False)
    log.save(datoms.where("tx <= 3000"))
    log.save(datoms.where("tx > 3000 or tx is null"))
    log.save(datoms.where("tx between 2000 and 4000"))
    return log


_VALUE = "coalesce(d.v_str, d.v_i64::varchar, d.v_u64::varchar, d.v_dec::varchar, d.v_ref::varchar)"


def _visible(basis: str | None = None, where: str = "true") -> str:
    """A subquery of the visible datoms (e, a, vt, val, tx), each once."""
    until = f"AND tx <= {basis}" if basis else ""
    return f"""(SELECT d.e, d.a, d.vt, {_VALUE} AS val, d.v_u64, d.v_ref, d.tx FROM (SELECT DISTINCT * FROM datoms WHERE op = 0 {until}) d
    LEFT JOIN (SELECT e, a, vt, {_VALUE} AS val, max(tx) AS tx FROM datoms d WHERE op = 1 {until} GROUP BY ALL) r ON r.e = d.e AND r.a = d.a AND r.vt = d.vt AND r.val IS NOT DISTINCT FROM {_VALUE}
    WHERE ({where}) AND (r.tx IS NULL OR r.tx <= d.tx))"""


# logs in files


@_query(f"SELECT e, val, tx FROM {_visible(where='d.a = 15 AND d.vt = 4')}")
def q_log_save_find(spark, d):
    """A log that was saved in parts, with rows that were written twice: the visible values of an attribute."""
    return _stored(spark, d).find(a=15, kind=V.STR).select("e", F.col("v_str").alias("val"), "tx")


@_query(f"SELECT a, vt, count(*) AS n FROM {_visible('4000')} GROUP BY a, vt")
def q_log_asof(spark, d):
    return _stored(spark, d).find(basis=4000).groupBy("a", "vt").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT a, tx, v_ref AS ref FROM {_visible(where='d.e = 900 AND d.vt = 5')}")
def q_log_entity(spark, d):
    return _stored(spark, d).find(e=900, kind=V.REF_TAG).select("a", "tx", F.col("v_ref").alias("ref"))


@_query(f"SELECT e, tx FROM {_visible(where='d.a = 9 AND d.vt = 2 AND d.v_u64 = 1990')}")
def q_log_value(spark, d):
    return _stored(spark, d).find(a=9, v=V.u64(1990)).select("e", "tx")


@_query("SELECT a, op, count(*) AS n, (SELECT max(e) FROM datoms) AS latest FROM (SELECT DISTINCT * FROM datoms) GROUP BY a, op")
def q_log_readonly(spark, d):
    """What a reader of the files sees: all rows once, and the id high-water mark of the manifest."""
    log = ParquetLog(spark, _stored(spark, d).path, read_only=True)
    rows = log.frame() if log.is_set() else log.frame().distinct()
    return rows.groupBy("a", "op").agg(F.count(F.lit(1)).alias("n")).withColumn("latest", F.lit(log.latest_entity_id()).cast("long"))


@_query("SELECT a, op, count(*) AS n, 1::bigint AS parts FROM datoms_once GROUP BY a, op".replace("datoms_once", "(SELECT DISTINCT * FROM datoms)"))
def q_log_compact(spark, d):
    """After compaction a log has one part, in which no row is repeated."""
    log = _stored(spark, d)
    log.compact()
    return log.frame().groupBy("a", "op").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.lit(len(log.parts())).cast("long"))


@_query("SELECT a, op, count(*) AS n FROM (SELECT DISTINCT * FROM datoms) GROUP BY a, op")
def q_log_stream(spark, d):
    """The datoms' files as a stream that is appended to a log; started a second time from nothing, it changes nothing.

    A pattern names the table, as a stream reads folders or patterns and not a single file.
    """
    log = ParquetLog(spark, _new_path(spark), bootstrap=False)
    for _ in range(2):
        append_to_log(datom_files(spark, f"{d}/[d]atoms.parquet"), log, "datoms", f"{_new_path(spark)}-stream").awaitTermination()
    return log.frame().groupBy("a", "op").agg(F.count(F.lit(1)).alias("n"))


# transactions: the submitted operations as one bulk transaction after the log of facts


def _operations(spark: SparkSession, d: str, by_entity: bool = True) -> DataFrame:
    """The table of operations in the columns of transact.OPERATIONS and the submitted transaction ``of_tx``.

    Temp ids are those of their submitted transaction. A value is read as its attribute's type where its
    text allows that, else it is a string; one that is absent is Nil.
    """
    attrs = spark.read.parquet(f"{d}/attrs.parquet").select(F.col("ident").alias("attr_ident"), "value_type")
    rows = spark.read.parquet(f"{d}/operations.parquet").join(attrs, "attr_ident", "left")
    whole, number = F.col("val").rlike("^[0-9]{1,18}$"), F.col("val").rlike("^-?[0-9]{1,18}([.][0-9]{1,18})?$")
    kind = F.when(F.col("val_temp_id").isNotNull(), 5).when(F.col("val").isNull(), 0).when(F.col("value_type").isin(1, 2, 5) & whole, F.col("value_type")).when((F.col("value_type") == 3) & number, 3).otherwise(4)
    rows = rows.withColumn("vt", kind.cast("tinyint")).withColumn("temp_id", F.concat_ws(":", "tx", "temp_id") if by_entity else F.col("temp_id"))
    rows = rows.withColumn("temp_id", F.when(F.col("entity_kind") == "temp_id", F.col("temp_id")))
    if by_entity:
        least = rows.where(F.col("temp_id").isNotNull()).groupBy("temp_id").agg(F.min("op_id").alias("op_no"))
        rows = rows.join(least, "temp_id", "left").withColumn("op_no", F.coalesce("op_no", "op_id"))
    else:
        rows = rows.withColumn("op_no", F.col("op_id"))
    lane = lambda t, to: F.when(F.col("vt") == t, F.col("val")).try_cast(to)
    return rows.select(
        "op_no", "entity_kind", F.col("e").alias("entity_id"), "temp_id", F.col("attr_ident").alias("attr"), "vt", lane(1, "long").alias("v_i64"), lane(2, "decimal(20,0)").alias("v_u64"), lane(3, "decimal(38,18)").alias("v_dec"),
        F.when(F.col("vt") == 4, F.col("val")).alias("v_str"), F.when(F.col("val_temp_id").isNull(), lane(5, "long")).alias("v_ref"), F.when(F.col("val_temp_id").isNotNull(), F.concat_ws(":", "tx", "val_temp_id")).alias("ref_temp_id"), "op", F.col("tx").alias("of_tx"),
    )


def _log(spark: SparkSession, d: str) -> DatomLog:
    return FrameLog(spark.read.parquet(f"{d}/datoms.parquet"))


def _judged(spark: SparkSession, d: str) -> tuple[DatomLog, DataFrame, DataFrame]:
    log, ops = _log(spark, d), _operations(spark, d)
    return log, ops, X.violations(log, X.resolve_operations(log, ops))


def _accepted(spark: SparkSession, d: str) -> tuple[DatomLog, int, DataFrame, DataFrame]:
    """The log, and the bulk transaction of all submitted ones no operation of which breaks a rule: id, datoms, temp ids."""
    log, ops, bad = _judged(spark, d)
    refused = cut_lineage(ops.join(bad.select("op_no").distinct(), "op_no", "left_semi").select("of_tx").distinct())
    return log, *X.bulk_transact(log, ops.join(refused, "of_tx", "left_anti").drop("of_tx"), 1_600_000_000)


_OPS = f"""typed AS (
  SELECT o.op_id, o.tx, o.entity_kind, o.e, CASE WHEN o.entity_kind = 'temp_id' THEN o.tx || ':' || o.temp_id END AS temp_id, o.attr_ident AS attr, o.val, o.tx || ':' || o.val_temp_id AS ref, o.op, t.id AS a, t.value_type AS decl, t.card, t.is_unique,
    CASE WHEN o.val_temp_id IS NOT NULL THEN 5 WHEN o.val IS NULL THEN 0 WHEN t.value_type IN (1, 2, 5) AND regexp_full_match(o.val, '[0-9]{{1,18}}') THEN t.value_type
         WHEN t.value_type = 3 AND regexp_full_match(o.val, '-?[0-9]{{1,18}}([.][0-9]{{1,18}})?') THEN 3 ELSE 4 END AS vt
  FROM operations o LEFT JOIN attrs t ON t.ident = o.attr_ident
), ops AS (
  SELECT *, CASE WHEN temp_id IS NULL THEN op_id ELSE min(op_id) OVER (PARTITION BY temp_id) END AS op_no, CASE WHEN vt = 5 AND ref IS NULL THEN val::bigint END AS ref_id,
    CASE WHEN ref IS NOT NULL THEN NULL WHEN vt IN (1, 2, 5) THEN val::bigint::varchar WHEN vt = 3 THEN val::decimal(38,18)::varchar WHEN vt = 4 THEN val END AS txt
  FROM typed
), latest AS (SELECT max(e) AS id FROM datoms),
vis AS (SELECT * FROM {_visible()}),
uniq AS (SELECT op_no, a, attr, vt, coalesce(txt, ref) AS txt, e, temp_id, entity_kind FROM ops WHERE is_unique AND op = 0),
bad AS (
  SELECT DISTINCT 'name' AS rule, op_no, attr AS what FROM ops WHERE a IS NULL
  UNION SELECT 'temp id missing', op_no, ref FROM ops WHERE ref IS NOT NULL AND ref NOT IN (SELECT temp_id FROM ops WHERE temp_id IS NOT NULL)
  UNION SELECT 'type', op_no, attr FROM ops WHERE vt <> decl
  UNION SELECT 'unique in transaction', u.op_no, u.attr FROM uniq u JOIN (SELECT a, vt, txt FROM uniq GROUP BY ALL HAVING count(*) > 1) x ON x.a = u.a AND x.vt = u.vt AND x.txt IS NOT DISTINCT FROM u.txt
  UNION SELECT 'unique in log', u.op_no, u.attr FROM uniq u JOIN vis v ON v.a = u.a AND v.vt = u.vt AND v.val IS NOT DISTINCT FROM u.txt AND (u.e IS NULL OR v.e <> u.e)
)"""
_DONE = f"""{_OPS}, good AS (SELECT * FROM ops WHERE tx NOT IN (SELECT tx FROM ops WHERE op_no IN (SELECT op_no FROM bad))),
temps AS (SELECT temp_id, (SELECT id FROM latest) + 1 + row_number() OVER (ORDER BY min(op_no)) AS id FROM good WHERE temp_id IS NOT NULL GROUP BY temp_id),
news AS (SELECT op_no, (SELECT id FROM latest) + 1 + (SELECT count(*) FROM temps) + row_number() OVER (ORDER BY op_no) AS id FROM (SELECT DISTINCT op_no FROM good WHERE entity_kind = 'new')),
said AS (
  SELECT DISTINCT CASE g.entity_kind WHEN 'id' THEN g.e WHEN 'temp_id' THEN t.id ELSE n.id END AS e, g.a, g.vt, coalesce(r.id::varchar, g.txt) AS val, g.op, g.card, g.entity_kind, g.ref IS NOT NULL AS by_name
  FROM good g LEFT JOIN temps t ON t.temp_id = g.temp_id LEFT JOIN news n ON g.entity_kind = 'new' AND n.op_no = g.op_no LEFT JOIN temps r ON r.temp_id = g.ref
), replaced AS (SELECT DISTINCT v.e, v.a, v.vt, v.val, 1 AS op FROM vis v JOIN (SELECT DISTINCT e, a FROM said WHERE card = 0) s ON s.e = v.e AND s.a = v.a),
data AS (SELECT e, a, vt, val, op FROM said UNION SELECT e, a, vt, val, op FROM replaced UNION SELECT (SELECT id FROM latest) + 1, 6, 2, '1600000000', 0)"""


def _text() -> F.Column:
    return F.coalesce("v_str", *[F.col(c).cast("string") for c in ("v_i64", "v_u64", "v_dec", "v_ref")])


@_query(f"WITH {_OPS} SELECT rule, op_no, what FROM bad")
def q_tx_violations(spark, d):
    """All operations that break a rule: unknown names, missing temp ids, wrong types, values that must be unique in the transaction and in the log."""
    return _judged(spark, d)[2]


@_query(f"WITH {_OPS} SELECT attr, vt, count(*) AS n FROM (SELECT DISTINCT op_no, attr, vt FROM ops WHERE vt <> decl) GROUP BY attr, vt")
def q_type_violations(spark, d):
    """Operations of another type than their attribute's, by the transaction's own check."""
    log, ops = _log(spark, d), _operations(spark, d)
    resolved = X.resolve_operations(log, ops)
    bad = X.violations(log, resolved).where("rule = 'type'").select("op_no", F.col("what").alias("attr"))
    kinds = resolved.rows.where("vt <> decl").select("op_no", "attr", F.col("vt").cast("int").alias("vt")).distinct()
    return kinds.join(bad, ["op_no", "attr"], "left_semi").groupBy("attr", "vt").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_OPS} SELECT rule, count(*) AS n FROM bad WHERE rule LIKE 'unique%' GROUP BY rule")
def q_unique_violations(spark, d):
    return _judged(spark, d)[2].where("rule like 'unique%'").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT DISTINCT o.op_id AS op_no, o.temp_id FROM operations o WHERE o.entity_kind = 'temp_id' AND o.temp_id IN (SELECT temp_id FROM operations WHERE entity_kind = 'temp_id' GROUP BY temp_id HAVING count(*) > 1)")
def q_tx_temp_id_twice(spark, d):
    """If every row were an entity of its own and temp ids were not of their transaction, most would be there twice."""
    log, ops = _log(spark, d), _operations(spark, d, by_entity=False)
    bad = X.violations(log, X.resolve_operations(log, ops))
    return bad.where("rule = 'temp id twice'").select("op_no", F.col("what").alias("temp_id"))


@_query(f"WITH {_DONE} SELECT e, a, vt, val, op FROM data")
def q_tx_data(spark, d):
    """All datoms of the accepted transactions."""
    data = _accepted(spark, d)[2]
    return data.select("e", "a", F.col("vt").cast("int").alias("vt"), _text().alias("val"), F.col("op").cast("int").alias("op"))


@_query(f"WITH {_DONE} SELECT temp_id, id FROM temps")
def q_tx_temp_ids(spark, d):
    return _accepted(spark, d)[3]


@_query(f"WITH {_DONE} SELECT count(DISTINCT e) AS entities, min(e) AS first, max(e) AS last FROM said WHERE entity_kind = 'new'")
def q_tx_new_entities(spark, d):
    """Entities without id or name, numbered after those with a temp id."""
    _, tx, data, temps = _accepted(spark, d)
    rows = data.where(F.col("e") > tx).join(temps.select(F.col("id").alias("e")), "e", "left_anti")
    return rows.agg(F.countDistinct("e").alias("entities"), F.min("e").alias("first"), F.max("e").alias("last"))


@_query(f"WITH {_DONE} SELECT e, a, val FROM said WHERE entity_kind = 'id' AND op = 0")
def q_tx_by_id(spark, d):
    """What is asserted of entities by their id."""
    log, tx, data, _ = _accepted(spark, d)
    return data.where((F.col("e") < tx) & (F.col("op") == V.ASSERT)).select("e", "a", _text().alias("val"))


@_query(f"WITH {_DONE} SELECT e, a, val FROM said WHERE op = 1 AND (e, a) NOT IN (SELECT (e, a) FROM said WHERE card = 0)")
def q_tx_retract(spark, d):
    """Retracts of many-valued attributes, which come from operations only."""
    log, _, data, _ = _accepted(spark, d)
    many = [x.id for x in log.catalog().by_id.values() if x.card == 1]
    return data.where(F.col("a").isin(many) & (F.col("op") == V.RETRACT)).select("e", "a", _text().alias("val"))


@_query(f"WITH {_DONE} SELECT e, a, val FROM replaced")
def q_tx_replacement(spark, d):
    """What one-valued attributes held before and is retracted as they are touched."""
    log, _, data, _ = _accepted(spark, d)
    one = [x.id for x in log.catalog().by_id.values() if x.card == 0]
    ended = data.where(F.col("a").isin(one) & (F.col("op") == V.RETRACT))
    before = log.find().select("e", "a", "vt", _text().alias("val")).distinct()
    return ended.select("e", "a", "vt", _text().alias("val")).join(before, ["e", "a", "vt", "val"], "left_semi").select("e", "a", "val")


@_query(f"WITH {_DONE}, many AS (SELECT DISTINCT e, a FROM said WHERE card = 1), rows AS (SELECT v.e, v.a, v.vt, v.val FROM vis v JOIN many m ON m.e = v.e AND m.a = v.a WHERE NOT EXISTS (SELECT 1 FROM said s WHERE s.op = 1 AND s.e = v.e AND s.a = v.a AND s.vt = v.vt AND s.val = v.val) UNION SELECT e, a, vt, val FROM said WHERE card = 1 AND op = 0) SELECT e, a, count(*) AS n FROM rows GROUP BY e, a")
def q_tx_many(spark, d):
    """The values of many-valued attributes that the transaction touched, old and new ones, after it."""
    log, _, data, _ = _accepted(spark, d)
    many = [x.id for x in log.catalog().by_id.values() if x.card == 1]
    after = FrameLog(log.frame().unionByName(data), log.catalog()).find().where(F.col("a").isin(many))
    touched = data.where(F.col("a").isin(many)).select("e", "a").distinct()
    return after.join(touched, ["e", "a"], "left_semi").select("e", "a", "vt", _text().alias("v")).distinct().groupBy("e", "a").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_DONE} SELECT e, a, val FROM said WHERE by_name AND op = 0")
def q_tx_references(spark, d):
    """References to entities that the transaction itself has made."""
    _, tx, data, _ = _accepted(spark, d)
    return data.where((F.col("vt") == V.REF_TAG) & (F.col("v_ref") > tx) & (F.col("op") == V.ASSERT)).select("e", "a", _text().alias("val"))


@_query("SELECT max(e) + 1 AS tx, 1600000000::bigint AS seconds FROM datoms")
def q_tx_clock(spark, d):
    """A transaction as an entity with its time, found by the query that asks for it."""
    log, tx, data, _ = _accepted(spark, d)
    both = FrameLog(log.frame().unionByName(data), log.catalog())
    q = Query().find("?tx", "?t").where("?tx", "db/tx/time", "?t", tx)
    return Database(both).query(q).select("tx", F.col("t").cast("long").alias("seconds"))


_CUSTOMERS = [AttributeDefinition("customer/label", V.STR).unique(), AttributeDefinition("customer/home", V.REF_TAG), AttributeDefinition("customer/credit", V.DECIMAL), AttributeDefinition("nation/label", V.STR).unique(), AttributeDefinition("nation/part-of", V.REF_TAG), AttributeDefinition("region/label", V.STR)]


@_query("SELECT n_name AS nation, r_name AS region, count(*) AS n, sum(cast(c_acctbal AS decimal(20,2)))::double AS credit FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def q_bulk_transact(spark, d):
    """Customers, nations and regions written to files by one bulk transaction with temp ids, read back and joined."""
    path = _new_path(spark)
    log = ParquetLog(spark, path)
    tx = X.Transaction()
    for a in _CUSTOMERS:
        tx.with_(a)
    X.Connection(log, lambda: 0).transact(tx)

    def operations(table: str, letter: str, first: int, key: str, *cells: tuple[str, str, int, str]) -> DataFrame:
        """One operation for each cell: attribute, column, type, and for references the letter of the other table."""
        rows = spark.read.parquet(f"{d}/{table}.parquet")
        none = lambda kind: F.lit(None).cast(kind)
        one = [
            F.struct(
                F.lit(attr).alias("attr"), F.lit(tag).cast("tinyint").alias("vt"), (F.col(c).cast("decimal(38,18)") if tag == V.DECIMAL else none("decimal(38,18)")).alias("v_dec"),
                (F.col(c) if tag == V.STR else none("string")).alias("v_str"), (F.concat(F.lit(to), F.col(c)) if to else none("string")).alias("ref_temp_id"),
            )
            for attr, c, tag, to in cells
        ]
        rows = rows.select((F.col(key).cast("long") + first).alias("op_no"), F.concat(F.lit(letter), F.col(key)).alias("temp_id"), F.explode(F.array(*one)).alias("x")).select("op_no", "temp_id", "x.*")
        return rows.select(
            "op_no", F.lit("temp_id").alias("entity_kind"), none("long").alias("entity_id"), "temp_id", "attr", "vt", none("long").alias("v_i64"), none("decimal(20,0)").alias("v_u64"), "v_dec", "v_str", none("long").alias("v_ref"), "ref_temp_id", F.lit(0).cast("tinyint").alias("op"),
        )

    ops = operations("region", "r", 0, "r_regionkey", ("region/label", "r_name", V.STR, ""))
    ops = ops.unionByName(operations("nation", "n", 1000, "n_nationkey", ("nation/label", "n_name", V.STR, ""), ("nation/part-of", "n_regionkey", V.REF_TAG, "r")))
    ops = ops.unionByName(operations("customer", "c", 10_000, "c_custkey", ("customer/label", "c_name", V.STR, ""), ("customer/home", "c_nationkey", V.REF_TAG, "n"), ("customer/credit", "c_acctbal", V.DECIMAL, "")))
    log.save(X.bulk_transact(log, ops, 0)[1])
    q = Query(numeric=True).find("?nation", "?region", count("n"), total("?b", "credit")).where("?c", "customer/home", "?n").where("?c", "customer/credit", "?b").where("?n", "nation/label", "?nation").where("?n", "nation/part-of", "?r").where("?r", "region/label", "?region")
    return Database(ParquetLog(spark, path, read_only=True)).query(q).select("nation", "region", "n", F.col("credit").cast("double").alias("credit"))


# errors, types and texts


@_query("SELECT unnest(['?nope', 'count ?nope', 'sum ?nope', '?name ?name']) AS found, 'InvalidFindVariable' AS error")
def q_unknown_variables(spark, d):
    """Variables that no clause binds, found plainly or in an aggregate, and one that is found twice: errors before anything runs."""
    db = Database(tables=star_tables(spark, d, ["supplier"]))
    rows = []
    for name, found in {"?nope": ["?nope"], "count ?nope": ["?nope", count()], "sum ?nope": [total("?nope")], "?name ?name": ["?name", "?name"]}.items():
        try:
            db.query(Query().find(*found).where("?s", "supplier/name", "?name"))
            rows.append((name, "none"))
        except InvalidFindVariable as error:
            rows.append((name, type(error).__name__))
    return spark.createDataFrame(rows, "found string, error string")


@_query("SELECT s_name AS name FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE false")
def q_types_never_meet(spark, d):
    """A name and a reference are of two types, so a variable that stands for both has no solution."""
    return Database(tables=star_tables(spark, d, ["supplier", "customer"])).q("[:find ?name :where [?s :supplier/name ?name] [?c :customer/nation ?name]]")


@_query("""SELECT '[Str("' || s_name || '"), Ref(' || (2::bigint * 281474976710656 + s_nationkey) || '), Decimal(' || s_acctbal::decimal(20,2)::decimal(38,18) || '), Ref(' || (4::bigint * 281474976710656 + s_suppkey) || ')]' AS row FROM supplier""")
def q_result_text(spark, d):
    q = Query().find("?name", "?nation", "?balance", "?s").where("?s", "supplier/name", "?name").where("?s", "supplier/nation", "?nation").where("?s", "supplier/acctbal", "?balance")
    return Database(tables=star_tables(spark, d, ["supplier"])).texts(q)


@_query("""SELECT '[:find ?name (count) :where [?p :part/name ?name] [?p :part/size 10]]' AS text, count(*) AS n FROM (SELECT p_name FROM part WHERE p_size = 10 GROUP BY p_name)""")
def q_edn_printed(spark, d):
    """A query that is read, printed, and run from what was printed."""
    text = edn.write(edn.read("[ :find ?name, (count) ; names\n :where [?p :part/name ?name], [?p :part/size 10] ]"))
    return Database(tables=star_tables(spark, d, ["part"])).q(text).select(F.lit(text).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items()}
