"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textprep.schema import RAW_SCHEMA, require_columns
from textprep.sources.csv_records import PLACE, read_records
from textprep.sources.scratch import delete, materialize, scratch_path, scratch_scope

__all__ = ["PLACE", "delete", "materialize", "scratch_path", "scratch_scope"]


#: Columns of numbers in files without a schema.
LABEL_COLUMNS = ("label", "labels", "toxic_positivity")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table read from few splits one partition per core; others are left as they are.

    Only for tables straight from a reader: large inputs already come in enough splits, and a
    small file in one split would otherwise be parsed by a single task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def placed(df: DataFrame) -> DataFrame:
    """``df``, straight from one of Spark's readers, with the columns that put rows in file order."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(PLACE[0]),
        F.col("_metadata.file_block_start").alias(PLACE[1]),
        F.monotonically_increasing_id().alias(PLACE[2]),
    )


def read_lines(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One-column table ``raw`` from CSV files without separators.

    Quoted lines are unquoted, blank lines skipped and commas kept: the separator is a control
    character. ``multi_line`` allows line breaks inside quotes; files are read by many tasks anyway.
    """
    if multi_line:
        return read_records(spark, path, RAW_SCHEMA, "\u0001", header=False)
    return (
        spark.read.schema(RAW_SCHEMA)
        .option("sep", "\u0001")
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One-column table ``raw`` of unquoted lines."""
    return spark.read.text(path).withColumnRenamed("value", "raw")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
    place: bool = False,
    split_bytes: int | None = None,
) -> DataFrame:
    """Table from CSV files with a header, each read by many tasks.

    Without ``schema`` all columns are strings, except that the label columns are numbers: values
    that are none, such as a stray word, become null. Texts that look like numbers stay texts.
    ``multi_line`` allows line breaks inside quotes, which takes a second scan (see
    :mod:`textprep.sources.csv_records`); ``split_bytes`` sets the size of its splits. ``place``
    adds the columns ``PLACE``.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    given = schema is not None
    if not given:
        schema = reader.option("multiLine", multi_line).csv(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if multi_line:
        df = read_records(spark, path, schema, place=place, split_bytes=split_bytes)
    else:
        df = reader.schema(schema).csv(path)
        df = placed(df) if place else df
    numbers = [] if given else [c for c in schema.names if c in LABEL_COLUMNS]
    return df.withColumns({c: whole_number(c) for c in numbers})


def whole_number(column: str) -> Column:
    """An integer from ``1`` or ``1.0``, else null."""
    value = F.expr(f"try_cast(trim(`{column}`) AS double)")
    return F.when(value == F.floor(value), value.try_cast("int"))


def load_checked(
    spark: SparkSession, path: str, columns: Sequence[str] = ("text", "label"), **options
) -> DataFrame:
    """Read a CSV table that must exist and must have ``columns``; options as in :func:`read_csv`."""
    return require_columns(read_csv(spark, path, **options), columns)


def load_optional(spark: SparkSession, path: str, **options) -> DataFrame | None:
    """Read a CSV table, or return ``None`` if there is nothing at ``path``."""
    try:
        return read_csv(spark, path, **options)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; quotes are doubled, so texts survive a round trip."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_splits(df: DataFrame, path: str) -> None:
    """Parquet, one directory per value of ``split``; the files carry the schema."""
    require_columns(df, ["split"]).write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(
    spark: SparkSession, path: str, split: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Splits written by :func:`write_splits`; only the named split and columns are read."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(df["split"] == split)
    return df.select(*columns) if columns else df


MODEL_COLUMNS = ("input_ids", "attention_mask", "labels")
