"""Union of sources, exact deduplication and light cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from textprep.functions.text import normalize_text
from textprep.schema import BINARY_LABELS

SOURCE_RANK = "source_rank"


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows by column name, absent columns null; ``source_rank`` keeps the order of sources."""
    ranked = [df.withColumn(SOURCE_RANK, F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def keep_labels(
    df: DataFrame, classes: Sequence[int] = BINARY_LABELS, label: str = "label"
) -> DataFrame:
    """Rows whose label is one of ``classes``; null labels are dropped."""
    return df.where(F.col(label).isin(*classes))


def dedup_first(
    df: DataFrame, subset: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """Keep the first row in ``order`` of every group of equal ``subset`` values.

    Spark plans a partial group limit before the exchange, so each map task sends at most one row
    per group however many copies it holds. Leading with a 64-bit hash makes the sorts compare
    long texts only when the hashes agree; the texts themselves still decide equality.
    """
    first = Window.partitionBy(F.xxhash64(*subset), *subset).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def clean_dataframe(
    df: DataFrame,
    order: Sequence[str | Column],
    text: str = "text",
    label: str = "label",
    within: Sequence[str] = (),
) -> DataFrame:
    """Normalize the text, drop empty texts, deduplicate on (text, label) keeping the first row.

    ``within`` adds columns whose values are deduplicated apart, such as language and split.
    """
    df = df.withColumn(text, normalize_text(text)).where(F.length(text) > 0)
    return dedup_first(df, [*within, text, label], order)
