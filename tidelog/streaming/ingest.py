"""Appending a stream of datoms to a log, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.values import LOG_SCHEMA
from tidelog.sources.log import ParquetLog


def datom_files(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the datoms in the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_to_log(stream: DataFrame, log: ParquetLog, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that appends every micro-batch to ``log``.

    The number of a batch is published in the log's manifest in the same step as its rows, so a batch
    that is run again after a failure changes nothing. The query is the log's one writer while it runs.
    """

    def add(batch: DataFrame, number: int) -> None:
        log.save(batch, (name, number))

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
