"""Labelled lines as a stream: parse, normalize, keep the first of equal rows.

New files of a folder are read as they come. The state store remembers which (text, label) pairs have
been written, across batches and restarts, so the output is what one batch over all files would give.
With ``within`` a pair is forgotten once the watermark, the latest arrival less that delay, has passed
it, which bounds the state; a copy that comes later is then written again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from textprep.functions.text import normalize_text
from textprep.operators.combine import keep_labels
from textprep.plans.jobs import parse_lines
from textprep.schema import BINARY_LABELS

ARRIVED = "arrived"


def line_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """``raw, arrived``: the lines of the files in ``folder``, and when their file was written."""
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder).select(
        F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias(ARRIVED)
    )


def prepared(
    lines: DataFrame,
    codes: Mapping[str, int],
    classes: Sequence[int] = BINARY_LABELS,
    within: str | None = None,
) -> DataFrame:
    """``text, label_str, label, arrived`` of a stream or a table of lines, each pair once."""
    rows = keep_labels(parse_lines(lines, codes), classes)
    rows = rows.withColumn("text", normalize_text("text")).where(F.length("text") > 0)
    if within is None:
        return rows.dropDuplicates(["text", "label"])
    return rows.withWatermark(ARRIVED, within).dropDuplicatesWithinWatermark(["text", "label"])


def run(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    codes: Mapping[str, int],
    within: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Work off what is in ``folder`` and end; the next run goes on after it.

    ``checkpoint`` holds the files that were read and the pairs that were written, ``out`` Parquet
    that each batch adds to exactly once.
    """
    rows = prepared(line_stream(spark, folder, files_per_batch), codes, within=within)
    query = (
        rows.drop(ARRIVED)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
