"""One query for each family of operators of the engine, over the star schema seen as facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import predicates as P
from tidelog.functions import values as V
from tidelog.plans.planner import Database
from tidelog.plans.query import Query, average, count, count_distinct, maximum, minimum, total
from tidelog.sources.importer import KEY_BITS, keyed_history, star_tables
from tidelog.sources.log import FrameLog
from tidelog.sources.schema import ONE, Attribute, Catalog

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None):
    def add(f):
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def _db(spark: SparkSession, d: str, *names: str) -> Database:
    return Database(tables=star_tables(spark, d, names))


def _entity(table: int, key: str) -> str:
    return f"({table << KEY_BITS} + {key}::bigint)"


# patterns, projections, filters


@_query("SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_const_value(spark, d):
    return _db(spark, d, "customer").q('[:find ?name :where [?c :customer/mktsegment "BUILDING"] [?c :customer/name ?name]]')


@_query(f"SELECT 3000 AS a, n_name AS str, -1 AS ref FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 3001, '', {_entity(1, 'n_regionkey')} FROM nation WHERE n_nationkey = 3")
def q_const_entity(spark, d):
    q = Query().find("?a", "?v").where((2 << KEY_BITS) + 3, "?a", "?v")
    return _db(spark, d, "nation").query(q).select("a", F.coalesce("v.v_str", F.lit("")).alias("str"), F.coalesce("v.v_ref", F.lit(-1)).alias("ref"))


@_query("SELECT p_name AS name, p_brand AS brand, p_size AS size FROM part WHERE p_size = 10")
def q_star_join(spark, d):
    got = _db(spark, d, "part").q("[:find ?name ?brand ?size :where [?p :part/name ?name] [?p :part/brand ?brand] [?p :part/size ?size] [?p :part/size 10]]")
    return got.select("name", "brand", F.col("size").cast("int").alias("size"))


@_query("SELECT o_orderpriority AS priority, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE'")
def q_ref_join(spark, d):
    return _db(spark, d, "orders", "customer").q('[:find ?priority ?name :where [?o :order/customer ?c] [?o :order/priority ?priority] [?c :customer/name ?name] [?c :customer/mktsegment "AUTOMOBILE"]]')


_CHAIN = """SELECT n_name AS nation, count(*) AS n, sum(l_quantity)::bigint AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'F' GROUP BY n_name"""


@_query(_CHAIN)
def q_ref_chain(spark, d):
    q = """[:find ?nation (count) (sum ?q) :where [?l :line/order ?o] [?l :line/quantity ?q] [?o :order/status "F"] [?o :order/customer ?c]
            [?c :customer/nation ?n] [?n :nation/name ?nation]]"""
    return _db(spark, d, "lineitem", "orders", "customer", "nation").q(q).toDF("nation", "n", "quantity")


@_query("SELECT c_name AS customer, s_name AS supplier FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_mktsegment = 'MACHINERY'")
def q_value_join(spark, d):
    return _db(spark, d, "customer", "supplier").q('[:find ?customer ?supplier :where [?c :customer/nation ?n] [?c :customer/name ?customer] [?c :customer/mktsegment "MACHINERY"] [?s :supplier/nation ?n] [?s :supplier/name ?supplier]]')


@_query("SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b")
def q_cross(spark, d):
    return _db(spark, d, "region").q("[:find ?x ?y :where [_ :region/name ?x] [_ :region/name ?y]]")


@_query("SELECT event_id AS e FROM events WHERE event_id = user_id")
def q_self_pattern(spark, d):
    """A variable in two positions of a clause: events whose own entity is the referred one."""
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("e"), F.col("user_id").alias("u"))
    rows = events.select("e", F.lit(900).cast("long").alias("a"), V.dynamic(V.REF_TAG, F.col("u")).alias("v"), F.lit(9).cast("long").alias("tx"), F.lit(0).cast("tinyint").alias("op")).select("e", "a", "v.*", "tx", "op")
    return Database(FrameLog(rows, Catalog([Attribute(900, "event/for", V.REF_TAG, ONE, False, 7)]))).q("[:find ?e :where [?e :event/for ?e]]")


@_query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
def q_blank_multiplicity(spark, d):
    got = _db(spark, d, "customer", "orders").q("[:find ?segment (count) :where [?c :customer/mktsegment ?segment] [?o :order/customer ?c] [?o :order/status _]]")
    return got.toDF("segment", "n")


@_query("SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def q_set_semantics(spark, d):
    return _db(spark, d, "orders").q("[:find ?status ?priority :where [?o :order/status ?status] [?o :order/priority ?priority]]", distinct=True)


@_query("SELECT p_name AS name, p_size::bigint AS size FROM part WHERE p_size BETWEEN 5 AND 9 AND p_brand IN ('Brand#1', 'Brand#3') AND p_type <> 'ECONOMY'")
def q_value_pred(spark, d):
    q = Query().find("?name", "?size").where("?p", "part/name", "?name").where("?p", "part/size", "?size").where("?p", "part/brand", "?brand").where("?p", "part/type", "?type")
    q.value_pred("?size", P.between(5, 9)).value_pred("?brand", P.isin("Brand#1", "Brand#3")).value_pred("?type", P.ne("ECONOMY"))
    return _db(spark, d, "part").query(q)


@_query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > p_size GROUP BY l_returnflag")
def q_general_pred(spark, d):
    q = "[:find ?flag (count) :where [?l :line/returnflag ?flag] [?l :line/quantity ?q] [?l :line/part ?p] [?p :part/size ?s] [(> ?q ?s)]]"
    return _db(spark, d, "lineitem", "part").q(q).toDF("flag", "n")


@_query("SELECT s_name AS name FROM supplier WHERE s_name LIKE '%7'")
def q_udf_pred(spark, d):
    q = Query().find("?name").where("?s", "supplier/name", "?name").value_pred("?name", lambda v: v.content.endswith("7"))
    return _db(spark, d, "supplier").query(q)


@_query("SELECT ident, count(*) AS n FROM (SELECT unnest(CASE WHEN s_name IS NULL THEN [] ELSE ['supplier/name'] END || CASE WHEN s_nationkey IS NULL THEN [] ELSE ['supplier/nation'] END || CASE WHEN s_acctbal IS NULL THEN [] ELSE ['supplier/acctbal'] END) AS ident FROM supplier) GROUP BY ident")
def q_attr_variable(spark, d):
    q = Query().find("?ident", count("n")).where("?e", "?a", "?v").where("?a", "db/attr/ident", "?ident").value_pred("?e", P.ge(V.ref(4 << KEY_BITS)))
    return _db(spark, d, "supplier").query(q)


@_query("SELECT 'customer/name' AS ident, 4::bigint AS type UNION ALL SELECT 'customer/nation', 5 UNION ALL SELECT 'customer/acctbal', 3 UNION ALL SELECT 'customer/mktsegment', 4")
def q_schema(spark, d):
    got = _db(spark, d, "customer").q("[:find ?ident ?type :where [?a :db/attr/ident ?ident] [?a :db/attr/type ?type]]")
    return got.select("ident", F.col("type").cast("bigint").alias("type"))


# time: each event replaces its user's last one


def _history(spark: SparkSession, d: str, basis: int | None = None) -> Database:
    events = spark.read.parquet(f"{d}/events.parquet")
    last = Attribute(900, "user/last-event", V.STR, ONE, False, 0)
    log = keyed_history(events.withColumn("tx", F.col("event_id") + 1), "user_id", "tx", F.col("event_type"), last)
    return Database(FrameLog(log, Catalog([last])), basis)


_EVENTS = "SELECT user_id, event_type, event_id + 1 AS tx FROM events"


def _last(basis: str) -> str:
    return f"SELECT user_id AS u, event_type AS type, tx FROM ({_EVENTS}) WHERE tx <= {basis} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY tx DESC) = 1"


@_query(_last("5000"))
def q_asof(spark, d):
    return _history(spark, d, 5000).q("[:find ?u ?type ?tx :where [?u :user/last-event ?type ?tx]]")


@_query(_last("9000000000"))
def q_latest_card_one(spark, d):
    return _history(spark, d).q("[:find ?u ?type ?tx :where [?u :user/last-event ?type ?tx]]")


@_query(f"SELECT type, count(*) AS n FROM ({_last('7000')}) GROUP BY type")
def q_tx_variable(spark, d):
    q = Query().find("?type", count("n")).where("?u", "user/last-event", "?type", "?tx").value_pred("?tx", P.gt(V.ref(0)))
    return _history(spark, d, 7000).query(q)


@_query(f"SELECT user_id AS u, event_type AS type FROM ({_EVENTS}) WHERE tx = 4000")
def q_tx_constant(spark, d):
    return _history(spark, d, 4000).q("[:find ?u ?type :where [?u :user/last-event ?type 4000]]")


@_query("SELECT d.e, t.v_u64::bigint AS seconds FROM datoms d JOIN (SELECT DISTINCT e, v_u64 FROM datoms WHERE a = 6 AND vt = 2 AND op = 0) t ON t.e = d.tx WHERE d.a = 9 AND d.vt = 2 AND d.op = 0 AND d.v_u64 = 1990 AND NOT EXISTS (SELECT 1 FROM datoms r WHERE r.op = 1 AND r.e = d.e AND r.a = 9 AND r.vt = 2 AND r.v_u64 = d.v_u64 AND r.tx > d.tx) GROUP BY ALL")
def q_tx_time(spark, d):
    """A transaction as a variable and as an entity, over the given log of facts."""
    log = FrameLog(spark.read.parquet(f"{d}/datoms.parquet"))
    q = Query().find("?e", "?t").where("?e", "movie/year", 1990, "?tx").where("?tx", 6, "?t")
    return Database(log).query(q, distinct=True).select("e", F.col("t").cast("bigint").alias("seconds"))


@_query("SELECT DISTINCT d.e, d.v_str AS likes FROM datoms d WHERE d.a = 15 AND d.vt = 4 AND d.op = 0 AND d.tx <= 20000 AND NOT EXISTS (SELECT 1 FROM datoms r WHERE r.op = 1 AND r.e = d.e AND r.a = 15 AND r.vt = 4 AND r.v_str = d.v_str AND r.tx > d.tx AND r.tx <= 20000)")
def q_card_many(spark, d):
    log = FrameLog(spark.read.parquet(f"{d}/datoms.parquet"))
    return Database(log, 20000).q("[:find ?e ?likes :where [?e :person/likes ?likes]]", distinct=True)


@_query("SELECT count(*) AS n, count(DISTINCT v_ref) AS targets FROM (SELECT DISTINCT * FROM datoms) d WHERE d.a = 11 AND d.vt = 5 AND d.op = 0 AND NOT EXISTS (SELECT 1 FROM datoms r WHERE r.op = 1 AND r.e = d.e AND r.a = 11 AND r.vt = 5 AND r.v_ref = d.v_ref AND r.tx > d.tx) HAVING count(*) > 0")
def q_retract(spark, d):
    log = FrameLog(spark.read.parquet(f"{d}/datoms.parquet"))
    return Database(log).query(Query().find(count("n"), count_distinct("?x", "targets")).where("?m", "movie/cast", "?x"))


_VISIBLE = "d.op = 0 AND d.tx <= {t} AND NOT EXISTS (SELECT 1 FROM datoms r WHERE r.op = 1 AND r.e = d.e AND r.a = d.a AND r.vt = d.vt AND r.v_i64 IS NOT DISTINCT FROM d.v_i64 AND r.v_u64 IS NOT DISTINCT FROM d.v_u64 AND r.v_dec IS NOT DISTINCT FROM d.v_dec AND r.v_str IS NOT DISTINCT FROM d.v_str AND r.v_ref IS NOT DISTINCT FROM d.v_ref AND r.tx > d.tx AND r.tx <= {t})"


@_query(f"SELECT d.a, d.tx, d.v_ref AS ref FROM (SELECT DISTINCT * FROM datoms) d WHERE d.e = 900 AND d.vt = 5 AND {_VISIBLE.format(t=30000)}")
def q_find_entity(spark, d):
    """A restricted scan as of a basis: all visible references of one entity."""
    log = FrameLog(spark.read.parquet(f"{d}/datoms.parquet"))
    return log.find(e=900, basis=30000).where("vt = 5").select("a", "tx", F.col("v_ref").alias("ref"))


@_query(f"SELECT d.e, d.tx FROM (SELECT DISTINCT * FROM datoms) d WHERE d.a = 13 AND d.vt = 4 AND d.v_str >= 'M' AND {_VISIBLE.format(t=9000000000000)}")
def q_find_attribute(spark, d):
    log = FrameLog(spark.read.parquet(f"{d}/datoms.parquet"))
    return log.find(a=13).where("vt = 4 AND v_str >= 'M'").select("e", "tx")


@_query(f"SELECT d.a, count(*) AS n FROM (SELECT DISTINCT * FROM datoms) d WHERE d.tx = (SELECT max(tx) FROM datoms WHERE tx <= 20000) AND {_VISIBLE.format(t=9000000000000)} GROUP BY d.a")
def q_find_tx(spark, d):
    """The visible datoms of one transaction, the last one up to 20000."""
    log = FrameLog(spark.read.parquet(f"{d}/datoms.parquet"))
    tx = log.frame().where("tx <= 20000").agg(F.max("tx")).first()[0]
    return log.find(tx=tx).groupBy("a").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT max(e) AS latest FROM datoms")
def q_latest_entity_id(spark, d):
    return spark.createDataFrame([(FrameLog(spark.read.parquet(f"{d}/datoms.parquet")).latest_entity_id(),)], "latest long")


@_query("SELECT 3001 AS a, count(*) AS n FROM nation UNION ALL SELECT 3000, count(*) FROM nation UNION ALL SELECT 2000, count(*) FROM region")
def q_table_cells(spark, d):
    """Every cell of some tables as a datom, under a variable attribute."""
    q = Query().find("?a", count("n")).where("?e", "?a", "_", 7).value_pred("?e", P.ge(V.ref(1 << KEY_BITS)))
    return _db(spark, d, "nation", "region").query(q)


# aggregates


@_query("SELECT count(*) AS n FROM orders HAVING count(*) > 0")
def q_count(spark, d):
    return _db(spark, d, "orders").query(Query().find(count("n")).where("?o", "order/status", "?s"))


@_query("SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY o_orderstatus")
def q_count_key(spark, d):
    return _db(spark, d, "orders").query(Query().find("?s", count("n")).where("?o", "order/status", "?s"))


@_query("SELECT p_brand AS brand, min(p_size)::bigint AS least FROM part GROUP BY p_brand")
def q_min(spark, d):
    return _db(spark, d, "part").query(Query().find("?b", minimum("?s", "least")).where("?p", "part/brand", "?b").where("?p", "part/size", "?s")).toDF("brand", "least")


@_query("SELECT max(p_size)::bigint AS most FROM part HAVING count(*) > 0")
def q_max(spark, d):
    return _db(spark, d, "part").query(Query().find(maximum("?s", "most")).where("?p", "part/size", "?s"))


@_query("SELECT sum(l_quantity)::bigint AS total FROM lineitem HAVING count(*) > 0")
def q_sum(spark, d):
    return _db(spark, d, "lineitem").query(Query().find(total("?q", "total")).where("?l", "line/quantity", "?q"))


@_query("SELECT l_returnflag AS f, min(l_quantity)::bigint AS least, max(l_quantity)::bigint AS most, sum(l_quantity)::bigint AS total FROM lineitem GROUP BY l_returnflag")
def q_min_max_sum(spark, d):
    q = Query().find("?f", minimum("?q", "least"), maximum("?q", "most"), total("?q", "total")).where("?l", "line/returnflag", "?f").where("?l", "line/quantity", "?q")
    return _db(spark, d, "lineitem").query(q)


# the quotient to 19 places, halves away from zero, in whole numbers
@_query("SELECT p_brand AS brand, (m // 10000000000000000000)::varchar || '.' || lpad((m % 10000000000000000000)::varchar, 19, '0') AS mean FROM (SELECT p_brand, (sum(p_size)::hugeint * 10000000000000000000 + count(*) // 2) // count(*) AS m FROM part GROUP BY p_brand)")
def q_avg(spark, d):
    q = Query().find("?brand", average("?s", "mean")).where("?p", "part/brand", "?brand").where("?p", "part/size", "?s")
    return _db(spark, d, "part").query(q).select("brand", F.col("mean").cast("string").alias("mean"))


@_query("SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def q_count_distinct(spark, d):
    q = Query().find("?f", count_distinct("?p", "parts")).where("?l", "line/returnflag", "?f").where("?l", "line/part", "?p")
    return _db(spark, d, "lineitem").query(q)


@_query("SELECT sum(l_quantity)::bigint AS total, l_returnflag AS f, count(*) AS n, l_linestatus AS s FROM lineitem GROUP BY l_returnflag, l_linestatus")
def q_multi_key_order(spark, d):
    q = Query().find(total("?q", "total"), "?f", count("n"), "?s").where("?l", "line/quantity", "?q").where("?l", "line/returnflag", "?f").where("?l", "line/linestatus", "?s")
    return _db(spark, d, "lineitem").query(q)


@_query("SELECT count(*) AS n, sum(p_size)::bigint AS total FROM part WHERE p_brand = 'none' HAVING count(*) > 0")
def q_agg_empty(spark, d):
    q = Query().find(count("n"), total("?s", "total")).where("?p", "part/brand", "none").where("?p", "part/size", "?s")
    return _db(spark, d, "part").query(q)


@_query("SELECT 'Nil' AS least, 'Nil' AS most, 0::bigint AS total, count(*) AS n FROM supplier HAVING count(*) > 0")
def q_agg_non_i64(spark, d):
    q = Query().find(minimum("?n", "least"), maximum("?n", "most"), total("?n", "total"), count("n")).where("?s", "supplier/name", "?n")
    nil = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Nil")).alias(c)
    return _db(spark, d, "supplier").query(q).select(nil("least"), nil("most"), "total", "n")


@_query("SELECT c_mktsegment AS segment, sum(cast(c_acctbal AS decimal(20, 2)))::double AS total FROM customer GROUP BY c_mktsegment")
def q_agg_numeric(spark, d):
    q = Query(numeric=True).find("?segment", total("?b", "total")).where("?c", "customer/mktsegment", "?segment").where("?c", "customer/acctbal", "?b")
    return _db(spark, d, "customer").query(q).select("segment", F.col("total").cast("double").alias("total"))


@_query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' GROUP BY o_orderpriority")
def q_edn_text(spark, d):
    q = """[:find ?priority (count) ; commas are white space
      :where [?o :order/priority ?priority], [?o :order/customer ?c], [?c :customer/nation ?n], [?n :nation/name "NATION_3"]]"""
    return _db(spark, d, "orders", "customer", "nation").q(q).toDF("priority", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql is not None}
