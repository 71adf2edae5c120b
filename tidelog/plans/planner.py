"""Queries to DataFrames: binding, typing, star collapse, join order, aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import values as V
from tidelog.functions.predicates import Predicate
from tidelog.plans.query import Aggregate, Blank, Clause, Constant, InvalidFindVariable, Query, QueryError, Test, Variable
from tidelog.sources.importer import VirtualTable
from tidelog.sources.log import DatomLog, FrameLog, restriction
from tidelog.sources.schema import BOOTSTRAP, IDENT, ONE, UNIQUE, Attribute, Catalog

#: Type of a variable whose type is only known by row.
ANY = None


@dataclass
class Scan:
    """One access to a source: its rows restricted, its columns named after variables."""

    frame: DataFrame
    types: dict[str, int | None]
    weight: int  # of constants; more come first


@dataclass
class Database:
    """A log, and tables seen as facts, as of a basis transaction; without a basis, as of now."""

    log: DatomLog | None = None
    basis: int | None = None
    tables: list[VirtualTable] = field(default_factory=list)

    def __post_init__(self) -> None:
        own = self.log.catalog(self.basis).by_id.values() if self.log is not None else []
        base = [Attribute(i, ident, tag, ONE, unique, 0) for i, ident, tag, _, unique in BOOTSTRAP]
        self.catalog = Catalog([*base, *own, *(a for t in self.tables for a in t.attributes())])
        self.table_of = {a.id: t for t in self.tables for a in t.attributes()}
        self.described = FrameLog(self.tables[0].frame.sparkSession.createDataFrame([r for t in self.tables for r in t.schema_rows()], V.LOG_SCHEMA), distinct=True) if self.tables else None

    def query(self, query: Query, distinct: bool = False) -> DataFrame:
        """The solutions, a bag unless ``distinct``, as a DataFrame with one column per found element."""
        out = Planner(self, query).plan()
        return out.distinct() if distinct else out

    def texts(self, query: Query) -> DataFrame:
        """The solutions of a query without aggregates as text, one column ``row``."""
        planner = Planner(self, query)
        if not all(isinstance(x, str) for x in query.found):
            raise QueryError("only variables are printed by type")
        s = planner.joined()
        return s.frame.select(V.row_text_column([(s.types[n], F.col(planner.columns[n])) for n in query.found]).alias("row"))

    def q(self, text: str, distinct: bool = False) -> DataFrame:
        """The same from EDN text."""
        from tidelog.plans.edn import parse

        return self.query(parse(text), distinct)


def column_name(variable: str) -> str:
    return variable.removeprefix("?")


class Planner:
    def __init__(self, db: Database, query: Query):
        self.db, self.query = db, query
        if not query.clauses:
            raise QueryError("a query needs at least one clause")
        if not query.found:
            raise QueryError("a query needs something to find")
        self.columns: dict[str, str] = {}
        for c in query.clauses:
            for v in c.free_variables():
                self.columns.setdefault(v, f"v{len(self.columns)}")
        self._validate()

    def _validate(self) -> None:
        plain = [x for x in self.query.found if isinstance(x, str)]
        aggregated = len(plain) < len(self.query.found)
        for x in self.query.found:
            name = x if isinstance(x, str) else x.variable
            if name is not None and name not in self.columns:
                raise InvalidFindVariable(name)
        if not aggregated and len(set(plain)) < len(plain):
            raise InvalidFindVariable("a variable can be found once")
        for t in self.query.tests:
            for name in t.variables:
                if name not in self.columns:
                    raise QueryError(f"{name} is in no clause")

    # clauses to scans

    def _attribute(self, c: Clause) -> Attribute | int | None:
        if not isinstance(c.a, Constant):
            return None
        a = c.a.content
        return self.db.catalog.resolve(a) or int(a)

    def scans(self) -> list[Scan]:
        out: list[Scan] = []
        stars: dict[tuple[int, str], list[tuple[Clause, Attribute]]] = {}
        for c in self.query.clauses:
            a = self._attribute(c)
            table = self.db.table_of.get(a.id) if isinstance(a, Attribute) else None
            if table is None:
                out.append(self._log_scan(c, a))
            elif isinstance(c.e, Variable) and isinstance(c.tx, Blank):
                stars.setdefault((id(table), c.e.name), []).append((c, a))
            else:
                out.append(self._table_scan(table, [(c, a)]))
        return out + [self._table_scan(self.db.table_of[star[0][1].id], star) for star in stars.values()]

    def _table_scan(self, table: VirtualTable, star: list[tuple[Clause, Attribute]]) -> Scan:
        """Clauses about the same entity of one table as one access to it; a null cell is no fact."""
        if self.db.basis is not None and self.db.basis < table.import_tx:
            table = table.emptied()
        bound: dict[str, list[tuple[int | None, Column]]] = {}
        where: list[Column] = []
        weight = 0

        def put(p: Variable | Constant | Blank, tag: int, c: Column) -> None:
            nonlocal weight
            if isinstance(p, Variable):
                bound.setdefault(p.name, []).append((tag, c))
            elif isinstance(p, Constant):
                weight += 1
                v = V.declared(p.content, tag)
                where.append(c == V.literal(v) if v.tag == tag else F.lit(False))

        put(star[0][0].e, V.REF_TAG, table.entity())
        for c, a in star:
            x = table.value(a)
            where.append(x.isNotNull())
            put(c.v, a.type, x)
            put(c.tx, V.REF_TAG, F.lit(table.import_tx).cast("long"))
        return self._scan(table.frame, bound, where, weight)

    def _log_scan(self, c: Clause, a: Attribute | int | None) -> Scan:
        """A clause over the log and, if its attribute is not fixed, over all cells of the tables as well."""
        log = self.db.log
        kind = a.type if isinstance(a, Attribute) else ANY
        a_id = a.id if isinstance(a, Attribute) else a
        e = int(c.e.content) if isinstance(c.e, Constant) else None
        v = None
        if isinstance(c.v, Constant):
            v = V.declared(c.v.content, kind) if kind is not ANY else V.value(c.v.content)
        tx = int(c.tx.content) if isinstance(c.tx, Constant) else None
        frames = [log.find(e, a_id, v, tx, self.db.basis, kind)] if log is not None else []
        if self.db.described is not None and (a_id is None or IDENT <= a_id <= UNIQUE):
            frames.append(self.db.described.find(e, a_id, v, tx, self.db.basis, kind))
        if a_id is None:
            for t in self.db.tables:
                if self.db.basis is None or self.db.basis >= t.import_tx:
                    where = restriction(e, None, v)
                    cells = t.cells()
                    frames.append((cells.where(where) if where is not None else cells).where(F.col("tx") == tx if tx is not None else F.lit(True)))
        if not frames:
            frames = [self.db.described.frame().limit(0)]
        frame = reduce(DataFrame.unionByName, [f.select(*V.LOG_SCHEMA.names) for f in frames])
        bound: dict[str, list[tuple[int | None, Column]]] = {}
        for p, tag, x in (
            (c.e, V.REF_TAG, F.col("e")),
            (c.a, V.REF_TAG, F.col("a")),
            (c.v, kind, F.col(V.LANES[kind]) if kind is not ANY else F.struct("vt", *V.LANES.values())),
            (c.tx, V.REF_TAG, F.col("tx")),
        ):
            if isinstance(p, Variable):
                bound.setdefault(p.name, []).append((tag, x))
        # a row of a type without a value of it is no fact
        where = [F.col("vt") == kind, F.col(V.LANES[kind]).isNotNull()] if kind is not ANY else []
        return self._scan(frame, bound, where, sum(isinstance(p, Constant) for p in (c.e, c.v, c.tx)) + (a_id is not None))

    def _scan(self, frame: DataFrame, bound: dict[str, list[tuple[int | None, Column]]], where: list[Column], weight: int) -> Scan:
        cols, types = [], {}
        for name, places in bound.items():
            tag, x = min(places, key=lambda p: p[0] is ANY)
            for other, y in places:
                if y is not x:
                    where.append(equal(tag, x, other, y))
            cols.append(x.alias(self.columns[name]))
            types[name] = tag
        for w in where:
            frame = frame.where(w)
        return Scan(frame.select(*cols) if cols else frame.select(F.lit(1).alias("_one")), types, weight)

    # joins

    def joined(self) -> Scan:
        rest = self.scans()
        done = max(rest, key=lambda s: s.weight)
        rest.remove(done)
        frame, types = done.frame, dict(done.types)
        tests = list(self.query.tests)
        frame, tests = self._filtered(frame, types, tests)
        while rest:
            near = [s for s in rest if set(s.types) & set(types)]
            s = max(near or rest, key=lambda s: s.weight)
            rest.remove(s)
            frame = self._join(frame, types, s)
            for name, tag in s.types.items():
                if name not in types or types[name] is ANY:
                    types[name] = tag
            frame, tests = self._filtered(frame, types, tests)
        return Scan(frame, types, 0)

    def _join(self, left: DataFrame, types: dict[str, int | None], s: Scan) -> DataFrame:
        shared = [n for n in s.types if n in types]
        if not shared:
            return left.crossJoin(s.frame.drop("_one")) if "_one" in s.frame.columns else left.crossJoin(s.frame)
        right = s.frame
        on = []
        drop = []
        for n in shared:
            c = self.columns[n]
            a, b = types[n], s.types[n]
            if a is not ANY and b is not ANY and a != b:  # values of two types are never equal
                right = right.where(F.lit(False))
                a = b = types[n]
                right = right.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
            right = right.withColumnRenamed(c, f"_{c}")
            on.append(equal(a, F.col(c), b, F.col(f"_{c}")))
            drop.append(f"_{c}" if a is not ANY or b is ANY else c)
        out = left.join(right, reduce(lambda x, y: x & y, on)).drop(*drop)
        for c in drop:
            if not c.startswith("_"):
                out = out.withColumnRenamed(f"_{c}", c)
        return out

    def _filtered(self, frame: DataFrame, types: dict[str, int | None], tests: list[Test]) -> tuple[DataFrame, list[Test]]:
        """Applies the tests whose variables are all there."""
        later = []
        for t in tests:
            if not set(t.variables) <= set(types):
                later.append(t)
                continue
            cols = [F.col(self.columns[n]) for n in t.variables]
            tags = [types[n] for n in t.variables]
            frame = frame.where(condition(t, cols, tags))
        return frame, later

    # results

    def plan(self) -> DataFrame:
        s = self.joined()
        if all(isinstance(x, str) for x in self.query.found):
            return s.frame.select(*[F.col(self.columns[n]).alias(column_name(n)) for n in self.query.found])
        keys = list(dict.fromkeys(x for x in self.query.found if isinstance(x, str)))
        aggs = [self._aggregate(x, s.types).alias(f"_a{i}") for i, x in enumerate(self.query.found) if isinstance(x, Aggregate)]
        by = [F.col(self.columns[k]) for k in keys] or [F.lit(1).alias("_all")]
        out = s.frame.groupBy(*by).agg(*aggs)  # without keys and solutions there is no group, so no row
        cols, used = [], {}
        for i, x in enumerate(self.query.found):
            name = column_name(x) if isinstance(x, str) else x.name or "_".join([x.kind.replace("-", "_"), *([column_name(x.variable)] if x.variable else [])])
            used[name] = used.get(name, 0) + 1
            c = F.col(self.columns[x]) if isinstance(x, str) else F.col(f"_a{i}")
            cols.append(c.alias(name if used[name] == 1 else f"{name}_{used[name]}"))
        return out.select(*cols)

    def _aggregate(self, x: Aggregate, types: dict[str, int | None]) -> Column:
        """min, max, average and sum look at I64 only, unless the query is numeric; others count as absent."""
        if x.kind == "count":
            return F.count(F.lit(1))
        c, tag = F.col(self.columns[x.variable]), types[x.variable]
        if x.kind == "count-distinct":
            return F.countDistinct(c)
        if tag is ANY:
            c, tag = c["v_i64"], V.I64
        elif tag != V.I64 and not (self.query.numeric and tag in (V.U64_TAG, V.DECIMAL)):
            c, tag = F.lit(None).cast("long"), V.I64
        if x.kind in ("min", "max"):
            return F.min(c) if x.kind == "min" else F.max(c)
        if x.kind == "sum":
            return F.coalesce(F.sum(c), F.lit(0))
        if x.kind == "average":
            wide = T.DecimalType(19, 0) if tag == V.I64 else T.DecimalType(38, 18) if tag == V.DECIMAL else T.DecimalType(30, 0)
            return F.sum(c).cast(wide) / F.count(c).cast("decimal(19,0)")
        raise QueryError(f"no aggregate {x.kind}")


def equal(a: int | None, x: Column, b: int | None, y: Column) -> Column:
    """Equality of columns of types a and b; of a typed and a dynamic one, by the lane of the type."""
    if a is ANY and b is ANY:
        return x == y
    if a is ANY:
        return (x["vt"] == b) & (x[V.LANES[b]] == y)
    if b is ANY:
        return (y["vt"] == a) & (y[V.LANES[a]] == x)
    return x == y if a == b else F.lit(False)


def condition(t: Test, cols: list[Column], tags: list[int | None]) -> Column:
    if isinstance(t.condition, Predicate):
        return t.condition.column(cols[0], tags[0])
    if t.on == "columns":
        return t.condition(*cols)
    f = t.condition

    def read(column, tag: int | None) -> list[V.Value]:
        if tag is ANY:
            return [V.value_of(tuple(x.values())) for x in column.to_pylist()]
        return [V.Value(tag, int(x) if tag == V.U64_TAG and x is not None else x) for x in column.to_pylist()]

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([bool(f(*xs)) for xs in zip(*map(read, columns, tags))], pa.bool_())

    # whole Arrow batches of the lanes; only the values of a variable attribute travel as structs
    return F.arrow_udf(run, T.BooleanType())(*cols)
