"""Processing only new or changed records, by fingerprints of partitions.

A partition is a hash bucket of the record key. Its fingerprint is its number of records and the sum of
their hashes, both additive, so a run's fingerprint is the last one's plus what the changes add and take
away. A partition whose fingerprint is as it was at the last successful run is not looked into again.
``IncrementalTable`` does one run after another and keeps its state in a folder; ``changes_by_run``
replays many runs at once by the same fingerprints.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.sources.files import Folder, Versions

#: Least number of buckets; there is one for about each ROWS_A_BUCKET records where that gives more.
BUCKETS, ROWS_A_BUCKET = 256, 1_000_000
#: Buckets of a replay for each shuffle partition, so that these are evenly filled.
BUCKETS_A_PARTITION = 16
_PRINTS = "bucket int, n long, h decimal(38,0), made_by string, changed boolean"


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def row_hash(*cols: str | Column) -> Column:
    """A hash that can be summed without overflow: up to 10^18 rows fit the sum's 38 digits."""
    return F.xxhash64(*cols).cast("decimal(20,0)")


def fingerprints(rows: DataFrame, by: list[str], content: list[str]) -> DataFrame:
    """(*by, n, h): number of rows and sum of their hashes for each ``by``; nulls hash like values."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(row_hash(*content)).cast("decimal(38,0)").alias("h"))


class IncrementalTable:
    """A derived table that is recomputed by partition, only where its source has changed.

    ``path``/runs has a numbered file for each successful run, which names its attempt.
    ``path``/prints/<attempt> says for every bucket what the source's fingerprint was and which attempt
    made the bucket's rows; these lie under ``path``/data/made_by=<attempt>/bucket=<bucket>. A run
    writes its fingerprints, then the changed buckets (by dynamic partition overwrite, each replaced as
    a whole), and last publishes its file, which moves all of them at once. An attempt has folders of its
    own and never touches those of a published one. So until the file is there readers see the last
    successful run, all of it, and the next run compares with that one's fingerprints, to which the rows
    that readers see belong: wherever a run fails, nothing is skipped, repeated or lost.

    The number of buckets is fixed by the first run, from the size of its source if not given.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int | None = None):
        self.spark, self.path, self.key, self._buckets = spark, path.rstrip("/"), key, buckets
        self.folder = Folder(spark, path)
        self.runs = Versions(self.folder, "runs")

    def last_run(self) -> str | None:
        return (self.runs.latest()[1] or {}).get("run")

    def _prints(self, attempt: str | None) -> DataFrame:
        return self.spark.read.schema(_PRINTS).parquet(f"{self.path}/prints/{attempt}") if attempt else self.spark.createDataFrame([], _PRINTS)

    def run(self, run: str, source: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Recomputes what changed; returns the buckets.

        ``compute`` maps the rows of whole buckets to the result's rows, keeping the column ``bucket``.
        The last successful run does nothing when it is run again. ``source`` must stay as it is during
        the run; ``bucket``, ``made_by``, ``n`` and ``h`` must not be columns of it.
        """
        number, state = self.runs.latest()
        state = state or {}
        if run == state.get("run"):
            return []
        buckets = state.get("buckets") or self._buckets or max(BUCKETS, -(-source.count() // ROWS_A_BUCKET))
        attempt = f"{number + 1:012d}-{uuid.uuid4().hex[:12]}"
        rows = source.withColumn("bucket", bucket_of(self.key, buckets))
        now = fingerprints(rows, ["bucket"], source.columns)
        before = self._prints(state.get("attempt")).select("bucket", F.col("n").alias("n0"), F.col("h").alias("h0"), F.col("made_by").alias("by0"))
        changed = ~(F.col("n").eqNullSafe(F.col("n0")) & F.col("h").eqNullSafe(F.col("h0")))
        prints = now.join(before, "bucket", "full").select("bucket", "n", "h", F.when(changed, F.lit(attempt)).otherwise(F.col("by0")).alias("made_by"), changed.alias("changed"))
        prints.coalesce(1).write.parquet(f"{self.path}/prints/{attempt}")  # one row per bucket
        todo = self._prints(attempt).where("changed").select("bucket")
        numbers = sorted(r.bucket for r in todo.collect())
        schema = state.get("schema")
        if numbers:
            result = compute(rows.join(todo, "bucket", "left_semi")).withColumn("made_by", F.lit(attempt))
            schema = T.StructType([f for f in result.schema if f.name not in ("bucket", "made_by")]).jsonValue()
            result.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("made_by", "bucket").parquet(f"{self.path}/data")
        self.runs.publish(number + 1, {"run": run, "attempt": attempt, "buckets": buckets, "schema": schema})
        return numbers

    def read(self) -> DataFrame:
        """The result as of the last successful run; what other attempts have left behind does not count."""
        state = self.runs.latest()[1] or {}
        schema = T.StructType.fromJson(state["schema"]) if state.get("schema") else T.StructType()
        schema.add("made_by", T.StringType()).add("bucket", T.IntegerType())
        valid = self._prints(state.get("attempt")).where("n is not null").select("bucket", "made_by")
        attempts = [r.made_by for r in valid.select("made_by").distinct().collect()]  # at most one per run or bucket
        there = set(self.folder.names("data"))
        paths = [f"{self.path}/data/made_by={a}" for a in attempts if f"made_by={a}" in there]  # an attempt without rows has none
        if not paths:
            return self.spark.createDataFrame([], schema).drop("made_by")
        data = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)
        return data.join(valid, ["bucket", "made_by"], "left_semi").drop("made_by")

    def vacuum(self) -> None:
        """Removes the folders of attempts that the last successful run doesn't use; only while nobody reads an older one."""
        state = self.runs.latest()[1] or {}
        used = {r.made_by for r in self._prints(state.get("attempt")).select("made_by").distinct().collect()} | {state.get("attempt")}
        for name in self.folder.names("data"):
            if name.startswith("made_by=") and name.removeprefix("made_by=") not in used:
                self.folder.remove(f"data/{name}")
        for name in self.folder.names("prints"):
            if name != state.get("attempt"):
                self.folder.remove(f"prints/{name}")


def mapping_text(json_text: str) -> Column:
    """A JSON object as text that does not depend on order and spacing.

    A null, blank text and the JSON null are the empty mapping. Of entries with one key the last counts;
    an escaped key is the key it stands for; numbers are compared as they are written, so 1 and 1.0
    differ, and 1 is the same as "1". Text that is no JSON object stands for itself.
    """
    c = F.col(json_text)
    entries = F.map_entries(F.from_json(c, "map<string,string>"))
    keys = F.transform(entries, lambda x: x["key"])
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))
    once = F.when(F.size(F.array_distinct(keys)) == F.size(entries), entries).otherwise(last)
    return F.when(c.isNull() | F.trim(c).isin("", "null"), F.lit("[]")).otherwise(F.coalesce(F.to_json(F.array_sort(once)), c))


def next_cut(rows: DataFrame, at: str, cuts: DataFrame) -> DataFrame:
    """``rows`` with ``cut``, the least of ``cuts`` (cut) that is not before ``at``; rows beyond the last cut are left out.

    ``at`` and ``cut`` are microseconds. The time between the first cut and the last is divided into as
    many equal slots as there are cuts; a row meets its slot's few cuts, and the first one after them, in
    a table with one row per slot. That table is as small as the list of runs, and made in one task.
    """
    ends = cuts.agg(F.count("cut").alias("n"), F.min("cut").alias("first"), F.max("cut").alias("last")).first()
    if not ends.n:
        return rows.withColumn("cut", F.lit(None).cast("long")).where(F.lit(False))
    width = max(1, -(-(ends.last - ends.first + 1) // ends.n))

    def slot(c: Column) -> Column:
        return F.greatest(F.floor((c - F.lit(ends.first)) / F.lit(width)), F.lit(0)).cast("long")

    of_slot = cuts.groupBy(slot(F.col("cut")).alias("slot")).agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    following = F.min(F.element_at("cuts", 1)).over(Window.orderBy("slot").rowsBetween(1, Window.unboundedFollowing))
    slots = cuts.sparkSession.range(ends.n).select(F.col("id").alias("slot")).join(of_slot, "slot", "left").withColumn("following", following)
    placed = rows.where(F.col(at) <= F.lit(ends.last)).withColumn("slot", slot(F.col(at))).join(slots, "slot")
    inside = F.coalesce(F.get(F.filter("cuts", lambda c: c >= F.col(at)), F.lit(0)), F.col("following"))
    return placed.withColumn("cut", inside).drop("slot", "cuts", "following")


def changes_by_run(deliveries: DataFrame, runs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(run_id, key): for each run, the keys whose content is new or another than at the run before.

    ``deliveries`` (key, content, at, no): the content of a key as of a time is that of its latest
    delivery up to then; of several at one time, the one with the greatest no, then the greatest content.
    ``runs`` (run_id, cut): each reads what was there at its cut; of runs with one cut the least run_id
    gets the changes. Deliveries without a key or time, and those after the last cut, give nothing; a null
    content is a content; repeated rows change nothing; without runs there are no rows.

    Deliveries are reduced to one content per key and cut, map-side first, so a key has at most as many
    rows as there are runs, and move once more, by bucket. There each row adds the hash of its content to
    its bucket's fingerprint as of its run and takes away the one before. Where neither the number of
    keys nor the sum has changed from one run to the next, the bucket's keys are not compared at that run
    (all that came were repeats); in the others the contents themselves are, with those at the run before.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cuts = runs.where(F.col("cut").isNotNull()).groupBy(micros("cut").alias("cut")).agg(F.min("run_id").alias("run_id"))
    rows = deliveries.where(F.col("key").isNotNull() & F.col("at").isNotNull()).select("key", "content", micros("at").alias("at"), "no")
    placed = next_cut(rows, "at", cuts.select("cut"))
    last = placed.groupBy("key", "cut").agg(F.max(F.struct("at", "no", "content")).alias("x")).select("key", "cut", F.col("x.content").alias("content"))
    buckets = buckets or max(BUCKETS, BUCKETS_A_PARTITION * int(deliveries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    last = last.withColumn("bucket", bucket_of("key", buckets)).repartition("bucket")
    new = _compared(changed_buckets(last))
    return new.join(cuts, "cut").select("run_id", "key")


def changed_buckets(last: DataFrame) -> DataFrame:
    """The rows (bucket, key, cut, content) of those buckets and cuts whose fingerprint is another than at the cut before."""
    of_key = Window.partitionBy("bucket", "key").orderBy("cut")
    cell = Window.partitionBy("bucket", "cut")
    signed = last.withColumn("hash", row_hash("key", "content")).withColumn("was", F.lag("hash").over(of_key))
    delta = signed.withColumn("dn", F.sum(F.when(F.col("was").isNull(), 1).otherwise(0)).over(cell)).withColumn("dh", F.sum(F.col("hash") - F.coalesce("was", F.lit(0))).over(cell))
    return delta.where((F.col("dn") != 0) | (F.col("dh") != 0)).select("bucket", "key", "cut", "content")


def _compared(rows: DataFrame) -> DataFrame:
    """Those rows whose content is the key's first, or another than its last one; a cut without a row of the key had no change."""
    of_key = Window.partitionBy("bucket", "key").orderBy("cut")
    before, number = F.lag("content").over(of_key), F.row_number().over(of_key)
    return rows.withColumn("new", (number == 1) | ~before.eqNullSafe(F.col("content"))).where("new")


def result_changes(tx_results: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, tx_id) of the new or changed results for each succeeded run; see changes_by_run."""
    content = F.to_json(F.struct("n_datoms", mapping_text("temp_ids").alias("ids")))
    deliveries = tx_results.select(F.col("tx_id").alias("key"), content.alias("content"), F.col("arrived_at").alias("at"), F.col("delivery_id").alias("no"))
    good = runs.where(F.col("status") == "succeeded").select("run_id", F.col("cut_at").alias("cut"))
    return changes_by_run(deliveries, good).withColumnRenamed("key", "tx_id")
