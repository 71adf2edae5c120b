"""Datoms that arrive as files: appended once, whatever is run again."""

from tidelog.functions import values as V
from tidelog.plans.planner import Database
from tidelog.plans.query import Query
from tidelog.sources.log import ParquetLog
from tidelog.streaming.ingest import append_to_log, datom_files


def test_appends_once(spark, tmp_path):
    source, log = str(tmp_path / "in"), ParquetLog(spark, str(tmp_path / "log"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), V.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        append_to_log(datom_files(spark, source, 1), log, "feed", str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.e, r.v) for r in Database(log).query(Query().find("?e", "?v").where("?e", 50, "?v").value_pred("?v", lambda v: True)).select("e", "v.v_i64").toDF("e", "v").collect())

    arrive(V.datom(100, 50, V.i64(1), 10), V.datom(101, 50, V.i64(2), 10))
    assert run("c1") == [(100, 1), (101, 2)]
    arrive(V.datom(100, 50, V.i64(1), 11, V.RETRACT), V.datom(100, 50, V.i64(3), 11))
    assert run("c1") == [(100, 3), (101, 2)]
    parts = len(log.manifest["parts"])
    # a batch that comes again, as after a failure between the rows and the stream's own checkpoint
    log.save(spark.createDataFrame([V.datom(102, 50, V.i64(9), 12)], V.LOG_SCHEMA), ("feed", log.manifest["marks"]["feed"]))
    assert run("c1") == [(100, 3), (101, 2)] and len(log.manifest["parts"]) == parts
    assert ParquetLog(spark, str(tmp_path / "log"), read_only=True).manifest["marks"] == log.manifest["marks"]
