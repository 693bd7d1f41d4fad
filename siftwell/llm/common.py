"""Helpers that the operators of this subpackage share.

Lineage is cut by writing Parquet into the shared folder that the session names
in ``spark.checkpoint.dir``; a folder of our own is used only where that setting
is absent (single-machine tests).
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources.tables import table as table

#: Six characters count as white space everywhere in this subpackage.
SPACE = "\\x20\\x09-\\x0D"
#: Records per Arrow batch handed to Python; bounds a worker's memory on long texts.
ARROW_ROWS = 512
ARROW_BYTES = 32 << 20

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; only an unset one falls back to a local folder."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="siftwell-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Spark deletes a query's shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it.

    What is written needs its lineage no more, so the shuffle files behind it go at once;
    disk holds those of one step, not of all.
    """
    path, conf = f"{shared_folder(df.sparkSession)}/siftwell/{label}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what :func:`materialise` wrote; results that still read it become invalid."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(hadoop).delete(path, True)


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and let Python workers on this machine import the package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def release() -> None:
    """Give free memory back to the system; allocators otherwise keep a worker at its peak."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``function`` of batches, behind which the worker holds no more than it keeps for its next task.

    Workers are kept after a task, beside the memory of the stages that need none.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def utf8(column: str | Column) -> Column:
    """A text as bytes, so that Python workers need not decode it; null is empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit("")).cast("binary")


def words(column: Column) -> Column:
    """Words of a text: maximal runs of anything but the six white-space characters."""
    return F.array_remove(F.split(F.coalesce(column, F.lit("")), f"[{SPACE}]+"), "")
