"""Queries over the log tables, each with equivalent SQL over the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import asof, changefeed, eager, history, incremental, orphans, widen
from tidelog.operators.facts import facts
from tidelog.operators.skew import quantile_edges
from tidelog.session import checkpoint_dir, cut_lineage

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.log_history(table(spark, d, "datoms"), table(spark, d, "attrs")).select("e", "a", "from_tx", "to_tx")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.replica_state(table(spark, d, "change_feed"), table(spark, d, "attrs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(table(spark, d, "datoms"), table(spark, d, "attrs"), table(spark, d, "operations"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of all keys with anything that holds, kept while the log comes in two parts, the second as changes to the first."""
    datoms, attrs = table(spark, d, "datoms"), table(spark, d, "attrs")
    rows, middle = facts(datoms, attrs), quantile_edges(datoms.select("tx"), "tx", 2)[0]
    known, first = orphans.apply_changes(None, rows.where(F.col("tx") < middle))
    counts, known = cut_lineage(orphans.add_counts(first)), cut_lineage(known)
    _, second = orphans.apply_changes(known, rows.where(F.col("tx") >= middle))
    counts = orphans.add_counts(counts.unionByName(second))
    return counts.where((F.col("refs") != 0) | (F.col("live") != 0)).select("key", "refs", "live", F.coalesce("born", F.lit(-1)).alias("born"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.result_changes(table(spark, d, "tx_results"), table(spark, d, "runs"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """The latest result of each transaction in a table that four runs over the growing deliveries have kept, one of which fails first."""
    results, runs = table(spark, d, "tx_results"), table(spark, d, "runs").where("status = 'succeeded'")
    cuts = runs.agg(F.percentile(F.unix_micros("cut_at"), F.array(*[F.lit(x / 4) for x in (1, 2, 3, 4)])).alias("c")).first().c or []
    kept = incremental.IncrementalTable(spark, f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}", "tx_id")

    def latest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("bucket", "tx_id").agg(F.max(F.struct("arrived_at", "delivery_id", "n_datoms")).alias("x"))
        return last.select("bucket", "tx_id", "x.delivery_id", "x.n_datoms")

    def fails(rows: DataFrame) -> DataFrame:
        raise InterruptedError

    for i, cut in enumerate(cuts):
        source = results.where(F.unix_micros("arrived_at") <= int(cut))
        if i == 2:
            try:
                kept.run(str(i), source, fails)
            except InterruptedError:
                pass
        kept.run(str(i), source, latest)
    return kept.read().select("tx_id", "delivery_id", "n_datoms")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return eager.attribute_totals(table(spark, d, "datoms"), table(spark, d, "attrs"))


def p5_joined(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of reads and log rows about one attribute, and the sum of the reads' basis over them, by the rows' type."""
    got = eager.joined_counts(table(spark, d, "snapshot_reads"), table(spark, d, "datoms"), "a", "vt", "basis_tx")
    return got.select(F.col("vt").cast("int").alias("vt"), F.col("rows").cast("long").alias("pairs"), F.col("total").cast("long").alias("total"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return asof.read_as_of(table(spark, d, "datoms"), table(spark, d, "attrs"), table(spark, d, "snapshot_reads"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.movies(table(spark, d, "datoms"), table(spark, d, "attrs"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_counts, p4_found, p4_table, p5_found, p5_joined, p6_found, p7_found)}


_VALUE = "coalesce(d.v_str, d.v_i64::varchar, d.v_u64::varchar, d.v_dec::varchar, d.v_ref::varchar)"
_FACTS = f"""
facts AS (
  SELECT DISTINCT d.e, d.a, d.vt, {_VALUE} AS v, d.tx, d.op, t.card
  FROM datoms d JOIN attrs t ON t.id = d.a AND t.value_type = d.vt
)"""


def _state(rows: str) -> str:
    """CTEs that end in ``held`` (e, a, v, vt, card, tx): what holds at the end of ``rows``."""
    return f"""
per_value AS (
  SELECT e, a, v, vt, card, max(CASE WHEN op = 0 THEN tx END) AS la, max(CASE WHEN op = 1 THEN tx END) AS lr
  FROM {rows} GROUP BY e, a, v, vt, card
), ranked AS (
  SELECT *, max(la) OVER (PARTITION BY e, a) AS m FROM per_value
), held AS (
  SELECT e, a, v, vt, card, la AS tx FROM ranked
  WHERE la IS NOT NULL AND (card = 1 OR la = m) AND (lr IS NULL OR lr <= la)
)"""


P1 = f"""
WITH {_FACTS}, one AS (SELECT * FROM facts WHERE card = 0 AND a > 6),
asserts AS (SELECT DISTINCT e, a, v, tx FROM one WHERE op = 0),
txs AS (
  SELECT e, a, tx, lead(tx) OVER (PARTITION BY e, a ORDER BY tx) AS nxt
  FROM (SELECT DISTINCT e, a, tx FROM asserts)
),
spans AS (
  SELECT s.e, s.a, s.v, s.tx AS from_tx,
         least(coalesce(any_value(t.nxt), 9000000000000000000), coalesce(min(r.tx), 9000000000000000000)) AS to_tx
  FROM asserts s JOIN txs t ON t.e = s.e AND t.a = s.a AND t.tx = s.tx
  LEFT JOIN one r ON r.op = 1 AND r.e = s.e AND r.a = s.a AND r.v = s.v AND r.tx > s.tx
  GROUP BY s.e, s.a, s.v, s.tx
),
marked AS (
  SELECT *, CASE WHEN lag(to_tx) OVER w = from_tx THEN 0 ELSE 1 END AS fresh
  FROM spans WINDOW w AS (PARTITION BY e, a, v ORDER BY from_tx)
),
grouped AS (
  SELECT *, sum(fresh) OVER (PARTITION BY e, a, v ORDER BY from_tx) AS n FROM marked
)
SELECT e, a, min(from_tx) AS from_tx,
       CASE WHEN max(to_tx) = 9000000000000000000 THEN -1 ELSE max(to_tx) END AS to_tx
FROM grouped GROUP BY e, a, v, n
"""

P2 = f"""
WITH rows AS (
  SELECT DISTINCT d.e, d.a, d.vt, {_VALUE} AS v, d.tx, d.op, coalesce(t.card, 0) AS card
  FROM change_feed d LEFT JOIN attrs t ON t.id = d.a
), {_state("rows")}
SELECT e, a, v AS val, tx FROM held
"""

P3 = f"""
WITH {_FACTS}, {_state("facts")},
born AS (SELECT e, min(tx) AS born FROM facts WHERE op = 0 GROUP BY e),
live AS (SELECT DISTINCT e FROM held),
refs AS (
  SELECT h.e, h.a, h.v, h.tx,
         CASE WHEN b.e IS NULL THEN 'missing' WHEN l.e IS NULL THEN 'deleted' WHEN b.born > h.tx THEN 'later' END AS kind
  FROM held h LEFT JOIN born b ON b.e = h.v::bigint LEFT JOIN live l ON l.e = h.v::bigint
  WHERE h.vt = 5
),
found AS (
  SELECT 'datoms.v_ref' AS src, e || ':' || a || ':' || v || ':' || tx AS rec, kind, tx FROM refs
  UNION ALL
  SELECT DISTINCT 'datoms.a', d.e || ':' || d.a || ':' || d.tx,
         CASE WHEN t.id IS NULL THEN 'missing' WHEN d.tx < t.attr_version THEN 'later' END, d.tx
  FROM datoms d LEFT JOIN attrs t ON t.id = d.a
  UNION ALL
  SELECT DISTINCT 'operations.attr_ident', o.op_id::varchar,
         CASE WHEN t.id IS NULL THEN 'missing' WHEN o.tx < t.attr_version THEN 'later' END, o.tx
  FROM operations o LEFT JOIN attrs t ON t.ident = o.attr_ident
),
months AS (
  SELECT e AS tx, strftime(make_timestamp(arg_max(v_u64, tx)::bigint * 1000000), '%Y-%m') AS ym
  FROM datoms WHERE a = 6 AND vt = 2 AND op = 0 GROUP BY e
)
SELECT f.src, f.rec, f.kind, m.ym FROM found f LEFT JOIN months m ON m.tx = f.tx WHERE f.kind IS NOT NULL
"""

P3_COUNTS = f"""
WITH {_FACTS}, {_state("facts")},
counted AS (
  SELECT e AS key, 0 AS refs, 1 AS live FROM held UNION ALL SELECT v::bigint, 1, 0 FROM held WHERE vt = 5
),
born AS (SELECT e, min(tx) AS born FROM facts WHERE op = 0 GROUP BY e)
SELECT key, sum(refs)::bigint AS refs, sum(live)::bigint AS live, coalesce(any_value(born), -1) AS born
FROM counted LEFT JOIN born ON born.e = counted.key GROUP BY key
"""

P4 = """
WITH good AS (
  SELECT run_id, cut_at FROM runs WHERE status = 'succeeded'
),
content AS (
  SELECT tx_id, arrived_at, delivery_id, n_datoms,
         list_sort(list_transform(json_keys(j), lambda k: k || '=' || json_extract_string(j, '$."' || k || '"'))) AS ids
  FROM (SELECT *, coalesce(temp_ids, '{}')::json AS j FROM tx_results)
),
placed AS (
  SELECT c.*, (SELECT min(g.cut_at) FROM good g WHERE g.cut_at >= c.arrived_at) AS cut FROM content c
),
latest AS (
  SELECT tx_id, cut, n_datoms, ids FROM placed WHERE cut IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY tx_id, cut ORDER BY arrived_at DESC, delivery_id DESC) = 1
),
compared AS (
  SELECT *, row_number() OVER w AS rn, lag(n_datoms) OVER w AS n0, lag(ids) OVER w AS ids0
  FROM latest WINDOW w AS (PARTITION BY tx_id ORDER BY cut)
)
SELECT g.run_id, c.tx_id FROM compared c JOIN good g ON g.cut_at = c.cut
WHERE c.rn = 1 OR c.n_datoms IS DISTINCT FROM c.n0 OR c.ids IS DISTINCT FROM c.ids0
"""

P4_TABLE = """
SELECT tx_id, delivery_id, n_datoms FROM tx_results
WHERE arrived_at <= (SELECT max(cut_at) FROM runs WHERE status = 'succeeded')
QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY arrived_at DESC, delivery_id DESC) = 1
"""

P5 = f"""
WITH {_FACTS}
SELECT a, count(*) AS n_facts, count(DISTINCT e) AS n_entities, min(tx) AS first_tx, max(tx) AS last_tx
FROM facts GROUP BY a
"""

P5_JOINED = """
SELECT d.vt::int AS vt, count(*) AS pairs, sum(r.basis_tx)::bigint AS total FROM snapshot_reads r JOIN datoms d ON d.a = r.a GROUP BY d.vt
"""

P6 = f"""
WITH {_FACTS}, one AS (SELECT * FROM facts WHERE card = 0),
reads AS (SELECT DISTINCT read_id, e, a, basis_tx FROM snapshot_reads WHERE basis_tx IS NOT NULL),
latest AS (
  SELECT r.read_id, r.e, r.a, r.basis_tx, max(f.tx) AS tx
  FROM reads r JOIN one f ON f.e = r.e AND f.a = r.a AND f.op = 0 AND f.tx <= r.basis_tx
  GROUP BY r.read_id, r.e, r.a, r.basis_tx
)
SELECT DISTINCT l.read_id, l.tx
FROM latest l JOIN one f ON f.e = l.e AND f.a = l.a AND f.op = 0 AND f.tx = l.tx
WHERE NOT EXISTS (
  SELECT 1 FROM one x WHERE x.op = 1 AND x.e = l.e AND x.a = l.a AND x.v = f.v AND x.tx > l.tx AND x.tx <= l.basis_tx
)
"""

P7 = f"""
WITH {_FACTS}, movie AS (
  SELECT f.*, t.ident FROM facts f JOIN attrs t ON t.id = f.a WHERE t.ident LIKE 'movie/%'
), {_state("movie")}, named AS (SELECT h.*, t.ident FROM held h JOIN attrs t ON t.id = h.a)
SELECT e,
  coalesce(max(CASE WHEN ident = 'movie/name' THEN v END), '') AS movie_name,
  coalesce(max(CASE WHEN ident = 'movie/year' THEN v::bigint END), -1) AS movie_year,
  coalesce(max(CASE WHEN ident = 'movie/gross' THEN (v::decimal(38,18) * 100)::bigint END), -1) AS gross_cents,
  coalesce(max(CASE WHEN ident = 'movie/producer' THEN v::bigint END), -1) AS producer_e,
  count(CASE WHEN ident = 'movie/cast' THEN 1 END) AS n_cast
FROM named GROUP BY e
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p2_found": P2, "p3_found": P3, "p3_counts": P3_COUNTS, "p4_found": P4, "p4_table": P4_TABLE, "p5_found": P5, "p5_joined": P5_JOINED, "p6_found": P6, "p7_found": P7}
