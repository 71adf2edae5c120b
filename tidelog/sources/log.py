"""The append-only log of datoms, a set of rows: in memory, or as Parquet files with an atomically replaced manifest."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidelog.functions.values import ASSERT, LANES, LOG_SCHEMA, RETRACT, Value, literal
from tidelog.sources.files import Folder, Versions
from tidelog.sources.schema import Catalog, bootstrap_rows

_SCHEMA_ATTRIBUTES = (1, 2, 3, 4, 5)
#: Parts that versions of a manifest name beside the last complete one; rows of a file at most; attributes with a folder of their own in a part at most.
_PARTS_A_VERSION, _ROWS_A_FILE, _OWN_FOLDERS = 64, 5_000_000, 64
#: The column of the attribute in files of the folder that the other attributes of a part share.
_SHARED = "shared_a"


def visible(log: DataFrame, basis: int | None, where: Column | None = None, retracts: bool = True, distinct: bool = False, kind: int | None = None) -> DataFrame:
    """Asserts up to ``basis`` that no later retract of the same fact, also up to it, has ended; each once.

    A log is a set: a datom counts once, however often it was written. ``where`` may restrict e, a and the
    value, ``kind`` the type of the values, so that only its lane is read; both are applied to asserts and
    retracts and reach the scans. The retracts are reduced to the latest of each fact first, so a fact
    meets one row at most. Repeats are removed by the columns that this join is by and tx, so where it
    shuffles they need no shuffle of their own. With ``retracts`` False the caller knows that there are
    none, with ``distinct`` that no row is repeated.
    """
    if where is not None:
        log = log.where(where)
    if kind is not None:
        log = log.where(F.col("vt") == kind)
    if basis is not None:
        log = log.where(F.col("tx") <= basis)
    # one struct, in which nulls are equal to each other
    lanes = list(LANES.values()) if kind is None else [LANES[kind]]
    rows = log.select("e", "a", F.struct("vt", *lanes).alias("_v"), "tx", "op")
    out = rows.where(F.col("op") == ASSERT).drop("op")
    if retracts:
        ends = rows.where(F.col("op") == RETRACT).groupBy(F.col("e").alias("_e"), F.col("a").alias("_a"), F.col("_v").alias("_w")).agg(F.max("tx").alias("_end"))
        out = out.join(ends, (F.col("e") == F.col("_e")) & (F.col("a") == F.col("_a")) & (F.col("_v") == F.col("_w")) & (F.col("_end") > F.col("tx")), "left_anti")
    if not distinct:
        out = out.distinct()
    cells = [F.col(f"_v.{n}") if n in lanes else F.lit(None).cast(LOG_SCHEMA[n].dataType).alias(n) for n in LANES.values()]
    return out.select("e", "a", F.col("_v.vt"), *cells, "tx", F.lit(ASSERT).cast("tinyint").alias("op"))


def restriction(e: int | None = None, a: int | None = None, v: Value | None = None) -> Column | None:
    """Equality on the given positions."""
    parts = [F.col("e") == e] if e is not None else []
    parts += [F.col("a") == a] if a is not None else []
    if v is not None:
        parts += [F.col("vt") == v.tag] + ([F.col(LANES[v.tag]) == literal(v)] if v.tag in LANES else [])
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


class DatomLog:
    """What a log offers: its rows, appending, what is visible, the schema, and the id high-water mark."""

    spark: SparkSession

    def frame(self) -> DataFrame:
        raise NotImplementedError

    def save(self, rows: Sequence[tuple] | DataFrame) -> None:
        raise NotImplementedError

    def latest_entity_id(self) -> int:
        raise NotImplementedError

    def has_retracts(self, a: int | None) -> bool:
        """Whether the attribute, or any if None, may have retracts."""
        return True

    def is_set(self) -> bool:
        """Whether no row of ``frame`` can be there twice."""
        return False

    def find(self, e: int | None = None, a: int | None = None, v: Value | None = None, tx: int | None = None, basis: int | None = None, kind: int | None = None) -> DataFrame:
        """The visible datoms with the given parts, and of type ``kind`` if given; ``tx`` and ``basis`` both apply."""
        out = visible(self.frame(), basis, restriction(e, a, v), self.has_retracts(a), self.is_set(), kind)
        return out if tx is None else out.where(F.col("tx") == tx)

    def rows_of(self, entities: Iterable[int] | None, attributes: Iterable[int], basis: int | None = None) -> list[tuple]:
        """The visible rows of a few attributes, and entities if given, brought to the driver.

        For the catalog, and for what one small transaction touches; ``bulk_transact`` does without it."""
        where = F.col("a").isin(sorted(attributes))
        if entities is not None:
            where = where & F.col("e").isin(sorted(entities))
        return [tuple(r) for r in visible(self.frame(), basis, where).select(*LOG_SCHEMA.names).collect()]

    def holders(self, a: int, values: Iterable[Value]) -> list[tuple]:
        """The visible rows in which an attribute has one of a few values."""
        by_tag: dict[int, list[Value]] = {}
        for v in values:
            by_tag.setdefault(v.tag, []).append(v)
        out: list[tuple] = []
        for tag, vs in by_tag.items():
            where = (F.col("a") == a) & F.col(LANES[tag]).isin([literal(v) for v in vs])
            out += [tuple(r) for r in visible(self.frame(), None, where).select(*LOG_SCHEMA.names).collect()]
        return out

    def catalog(self, basis: int | None = None) -> Catalog:
        return Catalog.of(self.rows_of(None, _SCHEMA_ATTRIBUTES, basis))


class MemoryLog(DatomLog):
    """A log in the driver's memory, for small data; a DataFrame that is saved comes to the driver whole."""

    def __init__(self, spark: SparkSession, bootstrap: bool = True):
        self.spark, self.rows = spark, []
        if bootstrap:
            self.save(bootstrap_rows())

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, LOG_SCHEMA)

    def save(self, rows: Sequence[tuple] | DataFrame) -> None:
        new = [tuple(r) for r in rows.select(*LOG_SCHEMA.names).collect()] if isinstance(rows, DataFrame) else list(rows)
        self.rows = list(dict.fromkeys(self.rows + new))

    def is_set(self) -> bool:
        return True

    def latest_entity_id(self) -> int:
        return max((r[0] for r in self.rows), default=0)

    def has_retracts(self, a: int | None) -> bool:
        return any(r[9] == RETRACT and a in (None, r[1]) for r in self.rows)

    def _visible(self, rows: Iterable[tuple], basis: int | None) -> list[tuple]:
        rows = [r for r in rows if basis is None or r[8] <= basis]
        ended: dict[tuple, int] = {}
        for r in rows:
            if r[9] == RETRACT:
                ended[r[:8]] = max(r[8], ended.get(r[:8], -1))
        return [r for r in rows if r[9] == ASSERT and ended.get(r[:8], -1) <= r[8]]

    def rows_of(self, entities: Iterable[int] | None, attributes: Iterable[int], basis: int | None = None) -> list[tuple]:
        some, of = set(attributes), None if entities is None else set(entities)
        return self._visible((r for r in self.rows if r[1] in some and (of is None or r[0] in of)), basis)

    def holders(self, a: int, values: Iterable[Value]) -> list[tuple]:
        from tidelog.functions.values import value_of

        wanted = set(values)
        return [r for r in self._visible((r for r in self.rows if r[1] == a), None) if value_of(r) in wanted]


class ParquetLog(DatomLog):
    """A log as Parquet files, partitioned by attribute and sorted by entity.

    A folder and a file for each attribute would be as many as there are attributes, so in a part with
    more than _OWN_FOLDERS of them only those with most rows have a folder. The others share the one of
    the null partition, sorted by attribute, which is then a column of the files and prunes their pages.

    A save writes a new part and then publishes a new version of the manifest, so readers see all of it
    or nothing, and a second writer is refused (see sources.files for where that holds). A reader keeps
    the version that it opened until ``refresh``.

    The manifest has the parts that count, each with its number of rows, its range of tx and whether
    it has a shared folder, the id high-water mark, the attributes with retracts, and how far each stream has been appended. A version
    lists the parts that came since the last complete version only, so that a save writes little
    however many parts there are; a complete one comes every _PARTS_A_VERSION parts.
    """

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, bootstrap: bool = True):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self.folder = Folder(spark, path)
        self.versions = Versions(self.folder, "manifest")
        self.refresh()
        if self.version == 0:
            if read_only:
                raise FileNotFoundError(path)
            self.save(bootstrap_rows() if bootstrap else [])

    def refresh(self) -> None:
        self.version, state = self.versions.latest()
        state = state or {"parts": [], "latest": 0, "retracted": [], "marks": {}, "since": None}
        self.since = state.pop("since")
        self._older: list[dict] = self.versions.read(self.since)["parts"] if self.since is not None else []
        self.manifest = state | {"parts": self._older + state["parts"]}

    def _publish(self, manifest: dict, whole: bool = False) -> None:
        number, older = self.version + 1, len(self._older)
        whole = whole or len(manifest["parts"]) - older >= _PARTS_A_VERSION
        if whole or self.since is None and self.version == 0:
            self.versions.publish(number, manifest | {"since": None})
            self.since, self._older = number, manifest["parts"]
        else:
            if self.since is None:  # the version that was opened is itself complete
                self.since, self._older = self.version, self.manifest["parts"]
                older = len(self._older)
            self.versions.publish(number, manifest | {"since": self.since, "parts": manifest["parts"][older:]})
        self.version, self.manifest = number, manifest

    def parts(self) -> list[str]:
        return [p["name"] for p in self.manifest["parts"]]

    def _frame(self, parts: Sequence[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        # a is the parts' partition column, read in the log's type
        read = self.spark.read.option("basePath", self.path)
        paths = [self.folder.at(p["name"]) for p in parts]
        if not any(p.get("shared") for p in parts):
            return read.schema(LOG_SCHEMA).parquet(*paths).select(*LOG_SCHEMA.names)
        rows = read.schema(StructType([*LOG_SCHEMA, StructField(_SHARED, LongType())])).parquet(*paths)
        return rows.where(F.col("a").isNotNull()).select(*LOG_SCHEMA.names).union(rows.where(F.col("a").isNull()).withColumn("a", F.col(_SHARED)).select(*LOG_SCHEMA.names))

    def frame(self) -> DataFrame:
        return self._frame(self.manifest["parts"])

    def is_set(self) -> bool:
        """A part has no repeats, and two parts can share a row only if their ranges of tx overlap."""
        ranges = sorted((p["from_tx"], p["to_tx"]) for p in self.manifest["parts"] if p["from_tx"] is not None)
        return len(ranges) == len(self.manifest["parts"]) and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))

    def save(self, rows: Sequence[tuple] | DataFrame, mark: tuple[str, int] | None = None) -> None:
        """Appends rows. ``mark`` (a stream and the number of its batch) makes that happen once: it is
        published with the rows, and a batch that is not beyond its stream's last is left out."""
        if self.read_only:
            raise PermissionError("the log was opened to be read")
        if mark is not None and self.manifest["marks"].get(mark[0], -1) >= mark[1]:
            return
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), LOG_SCHEMA)
        part = self._write(df)
        marks = self.manifest["marks"] | ({mark[0]: mark[1]} if mark else {})
        self._publish(self._described(part, self.manifest["parts"]) | {"marks": marks})

    def _write(self, df: DataFrame) -> dict:
        """A new part with each row once.

        Rows are spread by ranges of folder, attribute, entity, tx and a hash of the value, so an attribute
        or an entity that holds most of them is written by many tasks, and a task writes few files; removing
        repeats needs no other shuffle. The hash is computed again after the shuffle and not moved.
        """
        part = f"part={self.version:09d}-{uuid.uuid4().hex[:8]}"
        most = [r.a for r in df.groupBy("a").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a").limit(_OWN_FOLDERS + 1).collect()]
        shared = len(most) > _OWN_FOLDERS
        rows, order = df.select(*LOG_SCHEMA.names), ["a", "e", "tx"]
        if shared:
            own = F.col("a").isin([a for a in most[:_OWN_FOLDERS] if a is not None])
            rows, order = rows.withColumns({"a": F.when(own, F.col("a")), _SHARED: F.when(own, F.lit(None)).otherwise(F.col("a"))}), ["a", _SHARED, "e", "tx"]
        h = F.xxhash64("vt", *LANES.values())
        rows = rows.repartitionByRange(*order, h).withColumn("_h", h).distinct()
        rows.sortWithinPartitions(*order, "_h").drop("_h").write.option("maxRecordsPerFile", _ROWS_A_FILE).partitionBy("a").parquet(self.folder.at(part))
        return {"name": part, "shared": shared}

    def _described(self, part: dict, beside: list[dict]) -> dict:
        """The manifest with a new part beside others; what it says of the part is read from it."""
        latest, retracted, parts = self.manifest["latest"], set(self.manifest["retracted"]), list(beside)
        if any(n.startswith("a=") for n in self.folder.names(part["name"])):
            # one row per attribute
            tx = [F.min("tx").alias("lo"), F.max("tx").alias("hi"), F.count("tx").alias("with_tx"), F.count(F.lit(1)).alias("n")]
            got = self._frame([part]).groupBy("a").agg(F.max("e").alias("e"), F.max("op").alias("op"), *tx).collect()
            latest = max([latest, *(r.e for r in got if r.e is not None)])
            retracted |= {r.a for r in got if r.op == RETRACT}
            known = all(r.with_tx == r.n for r in got)
            parts.append(part | {"rows": sum(r.n for r in got), "from_tx": min(r.lo for r in got) if known else None, "to_tx": max(r.hi for r in got) if known else None})
        return self.manifest | {"parts": parts, "latest": latest, "retracted": sorted(retracted)}

    def compact(self, most_rows: int | None = None) -> None:
        """Rewrites the parts of at most ``most_rows`` rows, by default all, as one; the old files stay for readers that still use them."""
        if self.read_only:
            raise PermissionError("the log was opened to be read")
        small = [p for p in self.manifest["parts"] if most_rows is None or p["rows"] <= most_rows]
        if len(small) > 1:
            part = self._write(self._frame(small))
            self._publish(self._described(part, [p for p in self.manifest["parts"] if p not in small]), whole=True)

    def latest_entity_id(self) -> int:
        return self.manifest["latest"]

    def has_retracts(self, a: int | None) -> bool:
        known = self.manifest["retracted"]
        return bool(known) if a is None else a in known


class FrameLog(DatomLog):
    """A log that is an existing DataFrame in the log's schema, to be read only; ``distinct`` says that it has no repeats."""

    def __init__(self, df: DataFrame, catalog: Catalog | None = None, distinct: bool = False):
        self.spark, self.df, self._catalog, self._distinct = df.sparkSession, df.select(*LOG_SCHEMA.names), catalog, distinct

    def is_set(self) -> bool:
        return self._distinct

    def frame(self) -> DataFrame:
        return self.df

    def catalog(self, basis: int | None = None) -> Catalog:
        return self._catalog or super().catalog(basis)

    def latest_entity_id(self) -> int:
        return self.df.agg(F.coalesce(F.max("e"), F.lit(0))).first()[0]
