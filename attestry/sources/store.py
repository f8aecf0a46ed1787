"""Where intermediate tables go: the cluster's shared folder, never a machine's own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode, where none is set, a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="attestry-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again in the order and partitions of its files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt over as many tasks as a shuffle has: what comes next costs much for each row, and a scan has no more
    tasks than its files have row groups."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
