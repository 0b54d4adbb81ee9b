"""What the operators share: scratch tables, row keys and hashing of texts.

Code that runs in Python workers is pickled by value, so executors need no copy of this package.
"""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import textprep.llm

cloudpickle.register_pickle_by_value(textprep.llm)

#: White space of the operators on words and lines: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: Tables of known size are written in files of so many rows: shared storage suffers from tiny ones.
ROWS_A_FILE = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; below the warehouse where none is named."""
    return spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    )


class Scratch:
    """Tables of one job in the shared folder: they cut lineage and survive lost executors.

    ``drop`` deletes a table no later step reads. What a lazy result still reads stays until the
    program ends or ``close`` is called.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/textprep-{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write and reread a table; ``rows`` bounds its size where it is known, and its files with it."""
        if rows is not None:
            df = df.coalesce(group_count(rows, ROWS_A_FILE))
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None:  # the session has ended
            return
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def free_shuffles(self) -> None:
        """Let Spark delete the shuffle files of plans that are no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        atexit.unregister(self.close)
        self.drop("")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 200) -> Iterator[None]:
    """Actions inside send at most ``rows`` rows at once to Python: for rows that hold whole sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(
    df: DataFrame, only: Sequence[str] | None = None, **columns: Column | str
) -> DataFrame:
    """Columns of ``df`` as the struct ``doc``, beside the named ones: no name can clash."""
    doc = F.struct(*[F.col(quoted(c)) for c in only or df.columns]).alias("doc")
    extra = [(F.col(quoted(c)) if isinstance(c, str) else c).alias(k) for k, c in columns.items()]
    return df.select(doc, *extra)


def unpacked(df: DataFrame, names: Sequence[str], **columns: Column) -> DataFrame:
    """The named columns from ``doc``; ``columns`` replace those of the same name."""
    kept = [
        columns.pop(c).alias(c) if c in columns else F.col(f"doc.{quoted(c)}").alias(c)
        for c in names
    ]
    return df.select(*kept, *[c.alias(k) for k, c in columns.items()])


def row_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """``(k1, k2)``: a row's id and the hash of its text, never null.

    Rows with equal keys are copies of one row, and every operator treats them alike.
    """
    id_ = F.col(quoted(doc_id)).cast("long")
    k1 = F.coalesce(id_, F.lit(-(2**63)))
    return k1.alias("k1"), F.xxhash64(id_, F.col(quoted(text))).alias("k2")


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, which bounds what a task holds beside its input."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def mixed64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def group_count(rows: int, per_group: int) -> int:
    return max(1, -(-rows // per_group))
