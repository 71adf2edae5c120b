"""Things that depend on the session: the folder for checkpoints and tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, as the session names it.

    Where none is set, a temporary folder is taken if all of Spark runs in one process, as in tests; on a
    cluster, where executors could not reach each other's, that is an error.
    """
    set_dir = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="tidelog-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder and goes on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder, for what is read more than once; by columns, so smaller than a checkpoint.

    The tables stay until somebody empties the folder, as a result may be read at any time.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
