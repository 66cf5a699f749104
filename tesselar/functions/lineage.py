"""The folder that all executors share, plans cut there, and the size of Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch. A task's Python holds batches, not partitions, so its memory does not grow with the input.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession | None = None) -> None:
    """Bounds Arrow batches of a session's plans, as one row may hold a very long text."""
    if spark := spark or SparkSession.getActiveSession():
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session of one machine that names none gets one; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "tesselar-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """The rows as they are now, stored in the shared folder: a lost executor costs a read, not a recomputation."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared(rows.sparkSession))
    return rows.checkpoint()
