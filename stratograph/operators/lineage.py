"""Cutting lineage in iterative operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame


#: Rows that a task takes, about, of a table whose size is known.
TASK_ROWS = 200_000


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for ``rows`` rows: as many as the session's shuffles have, more for a larger table, so that a task's share doesn't grow."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into ``parts`` tasks; None leaves the number to the session."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


#: Whether Spark removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as columns in the checkpoint folder, written once: unlike ``checkpoint``'s rows, readers take only the columns they need.
    The shuffles that led to it are of no use then, and their files are removed."""
    spark = df.sparkSession
    checkpoint(spark.range(1))  # sets a folder where the session names none
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder, compression="zstd")
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder (spark.checkpoint.dir) and cut its lineage. Only a local session that
    names no folder, as in a test, gets one of its own; on a cluster it is an error to name none."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
