"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:  # else the session has ended
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what :func:`scratch_path` gave out inside."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            delete(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, the folder lies below the warehouse, which is shared too. What is written
    there is deleted when the scope around the call ends, or else when the program does.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    )
    path = f"{base.rstrip('/')}/textprep-{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(delete, spark, path)
    return path


@contextmanager
def session_setting(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    """Actions inside run with another value of a setting of the session."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int):
    """Actions inside send at most ``rows`` rows at once to Python, where a row holds a whole text."""
    return session_setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    For tables that several passes read: their lineage is not run again, and it survives the loss
    of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
