"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import DataFrame

from statloom.session import fresh_path

_open: list[list] = []  # paths written by the operators that are running, innermost last


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers live on and would hold it beside the next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """``run`` over a task's batches, with its memory released when the task ends."""
    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return task


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and go on from the stored rows.

    A lost executor then costs a reread, not the jobs before it, and the reader knows the table's size.
    """
    path = fresh_path(df.sparkSession, f"llm-{label}")
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(operator):
    """Store an operator's result and delete the tables it kept on the way, which nothing needs any more."""
    @functools.wraps(operator)
    def run(*args, **options):
        _open.append([])
        try:
            out = operator(*args, **options)
            spark = out.sparkSession
            path = fresh_path(spark, f"llm-{operator.__name__}")
            out.write.parquet(path)
        finally:
            written = _open.pop()
        for old in written:
            place = spark._jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if _open:
            _open[-1].append(path)
        return spark.read.schema(out.schema).parquet(path)
    return run
