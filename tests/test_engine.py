"""Transactions and queries end to end, over a log in memory and one in files."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.functions import predicates as P
from tidelog.functions import values as V
from tidelog.operators import transact as X
from tidelog.operators.transact import EntityOperation as Op
from tidelog.operators.transact import Transaction
from tidelog.plans import query as Q
from tidelog.plans.edn import parse
from tidelog.plans.planner import Database
from tidelog.plans.query import InvalidFindVariable, Query, QueryError
from tidelog.sources.files import ConcurrentWriter
from tidelog.sources.log import FrameLog, MemoryLog, ParquetLog
from tidelog.sources.schema import AttributeDefinition as Def
from tidelog.sources.schema import Catalog, IdentNotFound, bootstrap_rows

SCHEMA = [
    Def("movie/name", V.STR), Def("movie/year", V.U64_TAG), Def("movie/director", V.REF_TAG).many(), Def("movie/cast", V.REF_TAG).many(), Def("actor/name", V.STR),
    Def("person/name", V.STR).with_doc("A person's name"), Def("person/born", V.I64).with_doc("A person's birth year"), Def("person/likes", V.STR).with_doc("Things a person likes").many(),
    Def("person/email", V.STR).unique(), Def("artist/name", V.STR), Def("release/name", V.STR), Def("release/artists", V.REF_TAG).many(), Def("thing/price", V.DECIMAL),
]


class Sut(X.Connection):
    def __init__(self, log):
        super().__init__(log, lambda: 1_600_000_000)
        tx = Transaction()
        for d in SCHEMA:
            tx.with_(d)
        self.schema = self.transact(tx)

    def run(self, *ops, **how):
        tx = Transaction()
        for op in ops:
            tx.with_(op)
        return self.transact(tx, **how)

    def rows(self, query, basis=None, **how):
        query = parse(query) if isinstance(query, str) else query
        got = Database(self.log, self.last_tx if basis is None else basis).query(query, **how)
        return sorted((tuple(V.value_of(tuple(x)) if isinstance(x, tuple) else x for x in r) for r in got.collect()), key=str)


@pytest.fixture
def sut(spark):
    return Sut(MemoryLog(spark))


def beatles(sut):
    people = [("john", "John", 1940), ("paul", "Paul", 1942), ("george", "George", 1943), ("ringo", "Ringo", 1940)]
    ops = [Op.on_temp_id(t).assert_("person/name", n).assert_("person/born", b) for t, n, b in people]
    road = Op.on_temp_id("abbey-road").assert_("release/name", "Abbey Road")
    for t, _, _ in people:
        road.set_reference("release/artists", t)
    return sut.run(*ops, road)


def test_bootstrap():
    rows = bootstrap_rows()
    assert len(rows) == 26 and {r[8] for r in rows} == {0}
    assert {(a.id, a.ident, a.type, a.card, a.unique) for a in Catalog.of(rows).by_id.values()} == {
        (1, "db/attr/ident", 4, 0, True), (2, "db/attr/cardinality", 2, 0, False), (3, "db/attr/type", 2, 0, False), (4, "db/attr/doc", 4, 0, False), (5, "db/attr/unique", 2, 0, False), (6, "db/tx/time", 2, 0, False),
    }


def test_first_ids(sut):
    assert sut.schema.tx_id == 7
    assert sut.log.catalog().resolve("movie/name").id == 8 and sut.log.catalog().resolve("release/artists").id == 19
    assert sut.schema.tx_data[0] == V.datom(7, 6, V.u64(1_600_000_000), 7)


def test_no_match(sut):
    beatles(sut)
    assert sut.rows('[:find ?e :where [?e :person/name "Nobody"]]') == []


def test_temp_ids_and_references(sut):
    r = beatles(sut)
    assert sut.rows('[:find ?joe :where [?joe :person/name "John"]]') == [(r.temp_ids["john"],)]
    q = '[:find ?name :where [?a :person/name "John"] [?r :release/artists ?a] [?r :release/name ?name]]'
    assert sut.rows(q) == [("Abbey Road",)]
    assert V.row_text([V.value("Abbey Road")]) == '[Str("Abbey Road")]'


def test_rows_as_text(sut):
    """A column of texts is what row_text makes of the collected values, for every type and for values of any."""
    r = sut.run(Op.on_temp_id("x").assert_("person/likes", 'a "b" \\ c').assert_("person/likes", "").assert_("person/born", -5).assert_("movie/year", 2**64 - 1).assert_("thing/price", Decimal("-0.5")).set_reference("movie/cast", "x"))
    db = Database(sut.log)
    any_value = Query().find("?a", "?v").where(r.temp_ids["x"], "?a", "?v")
    want = sorted(V.row_text([V.ref(x[0]), V.value_of(tuple(x[1]))]) for x in db.query(any_value).collect())
    assert sorted(t.row for t in db.texts(any_value).collect()) == want and len(want) == 6
    typed = Query().find("?l", "?b").where("?p", "person/likes", "?l").where("?p", "person/born", "?b")
    assert sorted(t.row for t in db.texts(typed).collect()) == ['[Str(""), I64(-5)]', '[Str("a \\"b\\" \\\\ c"), I64(-5)]']
    with pytest.raises(QueryError):
        db.texts(Query().find(Q.count()).where("?p", "person/likes", "?l"))


def test_refusals(sut):
    with pytest.raises(X.InvalidAttributeType):
        sut.run(Op.on_new().assert_("person/name", 42))
    with pytest.raises(X.DuplicateTempId):
        sut.run(Op.on_temp_id("d"), Op.on_temp_id("d"))
    with pytest.raises(X.TempIdNotFound):
        sut.run(Op.on_new().set_reference("movie/cast", "nobody"))
    with pytest.raises(X.ResolveError):
        sut.run(Op.on_new().assert_("no/such", 1))
    with pytest.raises(X.ResolveError):  # declared in the same transaction is too late
        sut.run(Def("new/one", V.STR), Op.on_new().assert_("new/one", "x"))
    with pytest.raises(X.InvalidAttributeType):
        sut.run(Op.on_new().assert_("movie/year", V.i64(1967)))
    for bad in (2**64, -1):
        with pytest.raises(ValueError):
            sut.run(Op.on_new().assert_("movie/year", bad))
    assert sut.last_tx == 7


def test_cardinality_one_keeps_the_latest(sut):
    r = sut.run(Op.on_temp_id("joe").assert_("person/email", "foo@bar.com"))
    joe, first = r.temp_ids["joe"], sut.last_tx
    sut.run(Op.on_id(joe).assert_("person/email", "foo@baz.com"))
    q = "[:find ?m :where [?e :person/email ?m]]"
    assert sut.rows(q) == [("foo@baz.com",)]
    assert sut.rows(q, first) == [("foo@bar.com",)]


def test_cardinality_many_and_snapshots(sut):
    joe = sut.run(Op.on_temp_id("joe").assert_("person/name", "Joe").assert_("person/likes", "Pizza")).temp_ids["joe"]
    first = sut.last_tx
    sut.run(Op.on_id(joe).assert_("person/name", "Joe").assert_("person/likes", "Ice cream"))
    q = '[:find ?l :where [?e :person/name "Joe"] [?e :person/likes ?l]]'
    assert sut.rows(q) == [("Ice cream",), ("Pizza",)]
    assert sut.rows(q, first) == [("Pizza",)]
    sut.run(Op.on_id(joe).assert_("person/likes", "Pizza"))  # asserted again: two datoms, two solutions
    assert sut.rows(q) == [("Ice cream",), ("Pizza",), ("Pizza",)]
    assert sut.rows(q, distinct=True) == [("Ice cream",), ("Pizza",)]


def test_tx_patterns(sut):
    r = sut.run(Op.on_new().assert_("person/name", "Joe"))
    assert sut.rows('[:find ?tx ?t :where [_ :person/name "Joe" ?tx] [?tx :db/tx/time ?t]]') == [(r.tx_id, Decimal(1_600_000_000))]
    q = Query().find("?e", "?a", "?v").where("?e", "?a", "?v", r.tx_id)
    assert sut.rows(q) == [(r.tx_id, 6, V.u64(1_600_000_000)), (r.tx_id + 1, 13, V.value("Joe"))]
    later = sut.run(Op.on_new().assert_("person/name", "Ann"))
    assert sut.rows(Query().find("?e").where("?e", None, None, later.tx_id), r.tx_id) == []  # the basis holds as well


def test_aggregates(sut):
    beatles(sut)
    born = "[?p :person/born ?born]"
    assert sut.rows(f'[:find (count) :where [?p :person/name "John"] {born}]') == [(1,)]
    assert sut.rows(f"[:find ?born (count) :where {born}]") == [(1940, 2), (1942, 1), (1943, 1)]
    q = "[:find ?born ?r (count) (sum ?born) :where [?x :release/artists ?p] [?x :release/name ?r] [?p :person/born ?born]]"
    assert sut.rows(q) == [(1940, "Abbey Road", 2, 3880), (1942, "Abbey Road", 1, 1942), (1943, "Abbey Road", 1, 1943)]
    assert sut.rows(f"[:find (sum ?born) ?born :where {born}]") == [(1942, 1942), (1943, 1943), (3880, 1940)]
    assert sut.rows(f"[:find (min ?born) (max ?born) (avg ?born) :where {born}]") == [(1940, 1943, Decimal("1941.2500000000000000000"))]
    assert sut.rows('[:find (count) (sum ?b) :where [?p :person/name "Nobody"] [?p :person/born ?b]]') == []
    # other types than I64 do not count
    got = sut.rows("[:find (min ?n) (max ?n) (avg ?n) (sum ?n) (count-distinct ?n) :where [?p :person/name ?n]]")
    assert got == [(None, None, None, 0, 4)]
    r = sut.run(Op.on_new().assert_("movie/year", 2000), Op.on_new().assert_("movie/year", 2001))
    assert sut.rows("[:find (sum ?y) (min ?y) :where [_ :movie/year ?y]]") == [(0, None)]
    q = parse("[:find (sum ?y) (min ?y) (avg ?y) :where [_ :movie/year ?y]]")
    q.numeric = True
    assert [tuple(map(float, x)) for x in sut.rows(q)] == [(4001.0, 2000.0, 2000.5)]
    assert sut.rows(f"[:find (count) (max ?v) :where [_ _ ?v {r.tx_id}]]") == [(3, None)]


def test_count_distinct_with_key(sut):
    for name, likes, born in (("John", ("Pizza", "Ice cream"), 1967), ("John", ("Pizza", "Beer"), 1967), ("Mike", ("Pizza",), 1967), ("James", ("Beer",), 1963)):
        op = Op.on_new().assert_("person/name", name).assert_("person/born", born)
        for x in likes:
            op.assert_("person/likes", x)
        sut.run(op)
    q = "[:find ?n (count-distinct ?l) :where [?p :person/name ?n] [?p :person/likes ?l]]"
    assert sut.rows(q) == [("James", 1), ("John", 3), ("Mike", 1)]


def test_invalid_variables(sut):
    beatles(sut)
    for found in (["?nope"], ["?nope", Q.count()], [Q.total("?nope")], ["?n", "?n"]):
        with pytest.raises(InvalidFindVariable):
            sut.rows(Query().find(*found).where("?p", "person/name", "?n"))
    assert len(sut.rows(Query().find("?n", Q.count(), "?n").where("?p", "person/name", "?n"))) == 4
    for q in (Query().find("?x"), Query().where("?x"), Query().find("?n").where("?p", "person/name", "?n").value_pred("?z", P.gt(1))):
        with pytest.raises(QueryError):
            sut.rows(q)
    with pytest.raises(IdentNotFound):
        sut.rows("[:find ?x :where [?x :no/such _]]")


def test_predicates(sut):
    beatles(sut)
    base = lambda: Query().find("?n").where("?p", "person/born", "?b").where("?p", "person/name", "?n")
    want = [("George",), ("Paul",)]
    assert sut.rows(base().value_pred("?b", P.gt(1940))) == want
    assert sut.rows(base().value_pred("?b", lambda v: v.content > 1940)) == want
    assert sut.rows(base().pred(["?b", "?n"], lambda b, n: (b > 1940) & n.isNotNull())) == want
    assert sut.rows(base().pred(["?b", "?n"], lambda b, n: b.content > 1940 and n.content != "Paul", on="values")) == [("George",)]
    assert sut.rows("[:find ?n :where [?p :person/born ?b] [?p :person/name ?n] [(> ?b 1940)] [(!= ?n \"Paul\")]]") == [("George",)]
    assert sut.rows("[:find ?n ?m :where [?p :person/born ?b] [?p :person/name ?n] [?q :person/born ?c] [?q :person/name ?m] [(< ?c ?b)] [(= 1943 ?b)]]") == [("George", "John"), ("George", "Paul"), ("George", "Ringo")]
    for p, n in ((P.ge(1942), 2), (P.lt(1942), 2), (P.le(1942), 3), (P.eq(1940), 2), (P.ne(1940), 2), (P.between(1941, 1942), 1), (P.isin(1940, 1943), 3), (P.gt(V.u64(1)), 0)):
        assert len(sut.rows(base().value_pred("?b", p))) == n
    assert len(sut.rows(Query().find("?e").where("?e", None, "?v").value_pred("?v", P.starts_with("Geo")))) == 1
    assert len(sut.rows(Query().find("?e").where("?e", None, "?v").value_pred("?v", lambda v: v == V.value("George")))) == 1


def test_retracts(sut):
    joe = sut.run(Op.on_temp_id("joe").assert_("person/likes", "Pizza")).temp_ids["joe"]
    q = "[:find ?l :where [?e :person/likes ?l]]"
    assert sut.rows(q) == [("Pizza",)]
    sut.run(Op.on_id(joe).retract("person/likes", "Pizza"))
    assert sut.rows(q) == []
    sut.run(Op.on_id(joe).assert_("person/born", 1).assert_("person/born", 2))  # both of one transaction stay
    assert sut.rows("[:find ?b :where [_ :person/born ?b]]") == [(1,), (2,)]
    sut.run(Op.on_id(joe).retract("person/born", 5))  # any retract clears a one-valued attribute
    assert sut.rows("[:find ?b :where [_ :person/born ?b]]") == []


def test_unique_values(sut):
    a = sut.run(Op.on_temp_id("a").assert_("person/email", "x@y")).temp_ids["a"]
    with pytest.raises(X.DuplicateUniqueValue):
        sut.run(Op.on_new().assert_("person/email", "x@y"))
    with pytest.raises(X.DuplicateUniqueValue):
        sut.run(Op.on_new().assert_("person/email", "z"), Op.on_new().assert_("person/email", "z"))
    with pytest.raises(X.DuplicateUniqueValue):
        sut.run(Def("person/name", V.STR))
    with pytest.raises(X.DuplicateUniqueValue):
        sut.run(Op.on_id(a).assert_("person/email", "x@y"), strict_unique=True)
    sut.run(Op.on_id(a).assert_("person/email", "x@y"))
    assert sut.rows("[:find ?m :where [_ :person/email ?m]]") == [("x@y",)]
    sut.run(Op.on_id(a).retract("person/email", "x@y"))
    sut.run(Op.on_new().assert_("person/email", "x@y"))


def test_every_clause_counts(sut):
    r = beatles(sut)
    assert sut.rows('[:find ?r :where [?r :release/name "Abbey Road"] [?r :release/artists 1000000]]') == []
    # a clause that binds nothing new
    assert sut.rows('[:find ?r :where [?r :release/name "Abbey Road"] [?r :person/name _]]') == []
    # blanks multiply
    assert len(sut.rows("[:find ?r :where [?r :release/artists _]]")) == 4
    # the same variable twice in a clause
    e = r.temp_ids["john"]
    sut.run(Op.on_id(e).assert_("movie/director", V.ref(e)).assert_("movie/director", V.ref(e + 1)))
    assert sut.rows("[:find ?x :where [?x :movie/director ?x]]") == [(e,)]
    assert sut.rows("[:find ?x :where [?x _ ?x]]") == [(e,)]
    # differently typed variables never meet
    sut.run(Op.on_new().assert_("person/born", e))
    assert sut.rows("[:find ?x :where [?x :person/name _] [_ :person/born ?x]]") == []
    assert sut.rows("[:find ?x :where [_ :person/born ?x] [?x :person/name _]]") == []
    # no shared variable
    assert len(sut.rows("[:find ?a ?b :where [?a :person/name ?b] [?c :release/name ?d]]")) == 4


def test_dynamic_values_join(sut):
    r = beatles(sut)
    got = sut.rows(f"[:find ?n ?v :where [{r.temp_ids['john']} ?a ?v] [?a :db/attr/ident ?n]]")
    assert got == [("person/born", V.i64(1940)), ("person/name", V.value("John"))]
    # a dynamic variable meets a typed one, in either order
    assert len(sut.rows("[:find ?x :where [?r _ ?x] [?x :person/name \"John\"]]")) == 1
    assert len(sut.rows("[:find ?p ?q :where [?p _ ?v] [?q _ ?v] [?p :person/name \"John\"] [?q :person/name \"Ringo\"]]")) == 1
    assert len(sut.rows(Query().find("?e").where("?e", None, V.i64(1940)))) == 2
    assert sut.rows(Query().find("?e").where("?e", None, V.u64(1940))) == []


def test_ids_around_255(sut):
    for i in range(250, 262):
        sut.run(Op.on_id(i).assert_("person/likes", "Beer"))
    assert [x for (x,) in sut.rows('[:find ?e :where [?e :person/likes "Beer"]]')] == list(range(250, 262))


def test_files(spark, tmp_path):
    path = str(tmp_path / "log")
    sut = Sut(ParquetLog(spark, path))
    r = beatles(sut)
    assert sut.rows("[:find ?born (count) :where [?p :person/born ?born]]") == [(1940, 2), (1942, 1), (1943, 1)]
    sut.run(Op.on_id(r.temp_ids["john"]).assert_("person/born", 1941).assert_("movie/director", V.ref(r.temp_ids["paul"])))
    assert sut.log.manifest["retracted"] == [14]
    reader = ParquetLog(spark, path, read_only=True)
    with pytest.raises(PermissionError):
        reader.save([])
    other = ParquetLog(spark, path)
    other.save([V.datom(10**6, 15, V.value("late"), 1)])
    with pytest.raises(ConcurrentWriter):
        sut.log.save([V.datom(10**6, 15, V.value("later"), 1)])
    sut.log.refresh()
    reader.refresh()
    with pytest.raises(FileNotFoundError):
        ParquetLog(spark, str(tmp_path / "none"), read_only=True)
    before = sorted(map(str, reader.frame().collect()))
    sut.log.compact()
    assert len(sut.log.manifest["parts"]) == 1
    assert sorted(map(str, ParquetLog(spark, path).frame().collect())) == before == sorted(map(str, reader.frame().collect()))
    assert sut.rows("[:find ?born (count) :where [?p :person/born ?born]]") == [(1940, 1), (1941, 1), (1942, 1), (1943, 1)]
    sut.log.save([])
    assert sut.log.latest_entity_id() == reader.latest_entity_id()
    plan = sut.log.find(a=14, v=V.i64(1940))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(a" in plan and "(a#" in plan


@pytest.mark.parametrize("kind", ["memory", "files", "frame"])
def test_a_log_is_a_set(spark, tmp_path, kind):
    """A datom that is written again changes nothing: within a save, in a later one, asserts and retracts, with and without a basis."""
    log = MemoryLog(spark, bootstrap=False) if kind == "memory" else ParquetLog(spark, str(tmp_path / "log"))
    one, two, gone, back = (V.datom(100, 50, V.value("x"), t, op) for t, op in ((10, 0), (11, 0), (12, 1), (13, 0)))
    log.save([one, one, two])
    assert log.find(a=50).count() == 2
    log.save([one])
    if kind == "frame":
        log = FrameLog(log.frame().union(log.frame()))
    assert log.find(a=50).count() == 2 and log.find(a=50, kind=V.STR).count() == 2 and log.find(a=50, kind=V.I64).count() == 0
    if kind == "frame":
        return
    log.save([gone, gone, back, back])
    assert [r.tx for r in log.find(a=50).collect()] == [13] and log.find(a=50, basis=11).count() == 2 and log.find(a=50, basis=12).count() == 0
    if kind == "files":
        assert not log.is_set()
        log.compact()
        assert log.is_set() and log.find(a=50, basis=11).count() == 2


def test_a_fact_given_twice_is_one_datom(sut):
    r = sut.run(Op.on_temp_id("j").assert_("person/likes", "Tea").assert_("person/likes", "Tea"))
    assert len(r.tx_data) == 2 and sut.rows("[:find (count) :where [_ :person/likes _]]") == [(1,)]


def test_an_attribute_with_most_rows_is_written_by_many_tasks(spark, tmp_path):
    log = ParquetLog(spark, str(tmp_path / "log"))
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, 100).otherwise(F.col("id")).alias("e"), F.when(F.col("id") % 20 == 0, 51).otherwise(50).cast("long").alias("a"), F.lit(1).cast("tinyint").alias("vt"), F.col("id").alias("v_i64"), F.lit(None).cast("decimal(20,0)").alias("v_u64"),
        F.lit(None).cast("decimal(38,18)").alias("v_dec"), F.lit(None).cast("string").alias("v_str"), F.lit(None).cast("long").alias("v_ref"), F.lit(9).cast("long").alias("tx"), F.lit(0).cast("tinyint").alias("op"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log.save(rows.union(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for f in log.folder.names(f"{log.parts()[-1]}/a=50") if f.endswith(".parquet")]
    assert len(files) >= 3 and log.frame().where("a >= 50").count() == 40_000
    sizes = [spark.read.parquet(log.folder.at(f"{log.parts()[-1]}/a=50/{f}")).count() for f in files]
    assert max(sizes) < 20_000


def test_many_attributes_share_a_folder(spark, tmp_path):
    """Files of a part don't grow with the number of its attributes; each attribute, and none, is found as before."""
    path = str(tmp_path / "log")
    log = ParquetLog(spark, path)
    log.save([V.datom(100, 60, V.value("early"), 8), V.datom(100, 1200, V.value("gone"), 8)])  # a part in which each has its folder
    rows = [V.datom(100 + i, 60, V.i64(i), 9) for i in range(500)] + [V.datom(100 + a, 1000 + a, V.i64(a), 9) for a in range(300)]
    none = [(e, None, *V.datom(e, 1, V.i64(e), 9)[2:]) for e in (7, 8)]
    log.save(rows + none + rows[-5:])
    log.save([V.datom(100, 1200, V.value("gone"), 10, 1), V.datom(399, 1299, V.i64(299), 10, 1)])
    log.save(rows[:3] + rows[-3:])

    def found(log):
        return {a: sorted((r.e, r.tx) for r in log.find(a=a).collect()) for a in (60, 1000, 1200, 1298, 1299, 1300)}

    want = {60: sorted([(100, 8), *((100 + i, 9) for i in range(500))]), 1000: [(100, 9)], 1200: [(300, 9)], 1298: [(398, 9)], 1299: [], 1300: []}
    whole = sorted(map(str, log.frame().distinct().collect()))
    assert found(log) == want and log.frame().where("a is null").count() == 2 and log.manifest["retracted"] == [1200, 1299]
    assert [p["rows"] for p in log.manifest["parts"][1:]] == [2, 802, 2, 6]
    log.compact()
    for part in (log.manifest["parts"][0]["name"], next(n for n in log.folder.names() if n.startswith("part=000000002"))):
        folders = [n for n in log.folder.names(part) if n.startswith("a=")]
        assert len(folders) <= 65 and "a=60" in folders and sum(n.endswith(".parquet") for f in folders for n in log.folder.names(f"{part}/{f}")) <= 65 + 4
    reader = ParquetLog(spark, path, read_only=True)
    assert found(reader) == want and reader.is_set() and sorted(map(str, reader.frame().collect())) == whole and reader.latest_entity_id() == 599
    plan = reader.find(a=1298)._jdf.queryExecution().toString()
    assert "EqualTo(shared_a,1298)" in plan and "PartitionFilters: [isnull(a" in plan and "PartitionFilters: [isnotnull(a" in plan


def test_manifests_by_difference_and_compaction_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidelog.sources.log._PARTS_A_VERSION", 3)
    path = str(tmp_path / "log")
    log = ParquetLog(spark, path)
    for i in range(8):
        log.save([V.datom(100 + i, 50, V.i64(i), 10 + i)])
        assert {r.e for r in ParquetLog(spark, path).find(a=50).collect()} == {100 + k for k in range(i + 1)}
        assert len(log.versions.read(log.version)["parts"]) <= 3 or log.versions.read(log.version)["since"] is None
    log = ParquetLog(spark, path)  # goes on from a version with a difference
    log.save([V.datom(200, 50, V.i64(0), 30)])
    assert log.parts() == ParquetLog(spark, path).parts() and len(log.parts()) == 10
    log.compact(most_rows=5)  # all but the bootstrap
    assert len(log.parts()) == 2 == len(ParquetLog(spark, path).parts()) and log.is_set()
    assert log.find(a=50).count() == 9 and log.latest_entity_id() == 200
    with pytest.raises(ConcurrentWriter):
        log.versions.publish(log.version, {})


STORAGE = {
    "by e, a, v": ([(100, 101, 102, 103, 0)], dict(e=100, a=101, v=V.u64(102)), {(100, 101, 102)}),
    "by e": ([(100, 101, 1, 1000, 0), (100, 102, 2, 1000, 0)], dict(e=100), {(100, 101, 1), (100, 102, 2)}),
    "by tx": ([(100, 101, 1, 999, 0), (100, 102, 1, 1000, 0), (100, 103, 1, 1001, 0)], dict(tx=1000), {(100, 102, 1)}),
    "by a": ([(100, 102, 1, 1000, 0), (100, 102, 1, 1001, 1), (100, 102, 2, 1001, 0), (101, 102, 1, 1002, 0), (101, 103, 2, 1002, 0)], dict(a=102), {(100, 102, 2), (101, 102, 1)}),
    "other entities": ([(100, 102, 1, 1000, 0), (101, 102, 1, 1000, 0)], dict(e=100), {(100, 102, 1)}),
    "retracted": ([(100, 101, 1, 1000, 0), (100, 101, 1, 1001, 1)], dict(e=100, a=101), set()),
    "latest": ([(100, 101, 1, 1000, 0), (100, 101, 1, 1001, 1), (100, 101, 2, 1001, 0)], dict(e=100, a=101), {(100, 101, 2)}),
    "same tx": ([(100, 101, 1, 1000, 0), (100, 101, 1, 1000, 1)], dict(e=100), {(100, 101, 1)}),
    "as of": ([(100, 101, 1, 1000, 0), (100, 101, 1, 1001, 1)], dict(e=100, basis=1000), {(100, 101, 1)}),
    "empty": ([], dict(e=100), set()),
}


@pytest.mark.parametrize("case", STORAGE)
@pytest.mark.parametrize("kind", ["memory", "files"])
def test_storage(spark, tmp_path, case, kind):
    rows, how, want = STORAGE[case]
    log = MemoryLog(spark, bootstrap=False) if kind == "memory" else ParquetLog(spark, str(tmp_path / "log"))
    log.save([V.datom(e, a, V.u64(v), tx, op) for e, a, v, tx, op in rows])
    got = {(r.e, r.a, int(r.v_u64)) for r in log.find(**how).where(F.col("tx") > 0).collect()}
    assert got == want
    assert log.latest_entity_id() == max([r[0] for r in rows] + ([0] if kind == "memory" else [6]))


def test_values_round_trip(spark, tmp_path):
    xs = [V.i64(-(2**63)), V.i64(2**63 - 1), V.u64(2**64 - 1), V.dec("12345678901234567890.123456789012345678"), V.dec("-0.5"), V.value(""), V.value("x" * 70_000), V.value("é\n\x00日"), V.ref(2**63 - 1), V.Value(0)]
    log = ParquetLog(spark, str(tmp_path / "log"))
    log.save([V.datom(i + 100, 50, x, 9) for i, x in enumerate(xs)])
    got = {r.e: V.value_of(tuple(r)) for r in log.find(a=50).select(*V.LOG_SCHEMA.names).collect()}
    assert [got[i + 100] for i in range(len(xs))] == xs
    assert V.dec("1.0") == V.dec("1.00") and V.i64(5) != V.u64(5) != V.ref(5)
    assert sorted([V.ref(0), V.value("a"), V.dec(1), V.u64(3), V.i64(9), V.Value(0)]) == [V.Value(0), V.i64(9), V.u64(3), V.dec(1), V.value("a"), V.ref(0)]
    for bad in (True, 1.5, b"x"):
        with pytest.raises(TypeError):
            V.value(bad)


def bulk(spark, rows):
    out = []
    for r in rows:
        d = dict(op_no=None, entity_kind="new", entity_id=None, temp_id=None, attr=None, vt=None, v_i64=None, v_u64=None, v_dec=None, v_str=None, v_ref=None, ref_temp_id=None, op=0) | r
        out.append(tuple(d.values()))
    return spark.createDataFrame(out, X.OPERATIONS)


def test_bulk_transactions_agree(spark):
    a, b = Sut(MemoryLog(spark)), Sut(MemoryLog(spark))
    for s in (a, b):
        s.run(Op.on_temp_id("old").assert_("person/email", "old@x").assert_("person/born", 1))
    old = a.last_tx + 1
    r = a.run(
        Op.on_temp_id("t1").assert_("person/name", "N1").set_reference("movie/cast", "t2"), Op.on_new().assert_("person/likes", "Beer").assert_("person/likes", "Tea"), Op.on_temp_id("t2").assert_("movie/year", 1999),
        Op.on_id(old).assert_("person/born", 2).assert_("person/email", "old@x").retract("person/likes", "None"),
    )
    rows = [
        dict(op_no=1, entity_kind="temp_id", temp_id="t1", attr="person/name", vt=4, v_str="N1"), dict(op_no=1, entity_kind="temp_id", temp_id="t1", attr="movie/cast", ref_temp_id="t2"),
        dict(op_no=2, attr="person/likes", vt=4, v_str="Beer"), dict(op_no=2, attr="person/likes", vt=4, v_str="Tea"), dict(op_no=3, entity_kind="temp_id", temp_id="t2", attr="movie/year", vt=2, v_u64=Decimal(1999)),
        dict(op_no=4, entity_kind="id", entity_id=old, attr="person/born", vt=1, v_i64=2), dict(op_no=4, entity_kind="id", entity_id=old, attr="person/email", vt=4, v_str="old@x"), dict(op_no=4, entity_kind="id", entity_id=old, attr="person/likes", vt=4, v_str="None", op=1),
    ]
    tx, data, ids = X.bulk_transact(b.log, bulk(spark, rows), 1_600_000_000)
    assert tx == r.tx_id and {x.temp_id: x.id for x in ids.collect()} == r.temp_ids
    assert sorted(map(str, (tuple(x) for x in data.collect()))) == sorted(map(str, set(r.tx_data)))
    b.log.save(data)
    bad = [
        (X.ResolveError, dict(op_no=1, attr="no/such", vt=4, v_str="x")), (X.InvalidAttributeType, dict(op_no=1, attr="person/name", vt=1, v_i64=3)), (X.TempIdNotFound, dict(op_no=1, attr="movie/cast", ref_temp_id="none")),
        (X.DuplicateUniqueValue, dict(op_no=1, attr="person/email", vt=4, v_str="old@x")),
    ]
    for error, row in bad:
        with pytest.raises(error):
            X.bulk_transact(b.log, bulk(spark, [row]), 1)
    with pytest.raises(X.DuplicateTempId):
        X.bulk_transact(b.log, bulk(spark, [dict(op_no=i, entity_kind="temp_id", temp_id="t", attr="person/name", vt=4, v_str="x") for i in (1, 2)]), 1)
    for numbers in ((1, 2), (1, 1)):  # of two entities, and twice of one, as transact has it
        with pytest.raises(X.DuplicateUniqueValue):
            X.bulk_transact(b.log, bulk(spark, [dict(op_no=i, attr="person/email", vt=4, v_str="new@x") for i in numbers]), 1)
    with pytest.raises(X.DuplicateUniqueValue):
        a.run(Op.on_new().assert_("person/email", "new@x").assert_("person/email", "new@x"))
    ops = bulk(spark, [row | dict(op_no=i) for i, (_, row) in enumerate(bad)])
    got = X.violations(b.log, X.resolve_operations(b.log, ops))
    assert sorted((r.rule, r.op_no, r.what) for r in got.collect()) == [("name", 0, "no/such"), ("temp id missing", 2, "none"), ("type", 1, "person/name"), ("unique in log", 3, "person/email")]
    assert X.violations(b.log, X.resolve_operations(b.log, ops.limit(0))).count() == 0
