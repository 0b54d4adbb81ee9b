"""Identity of rows that have no id, from what they hold and not from where they stand.

Two rows with equal values are interchangeable, so a row is named by a hash of its values and a
number among its equals. The names are the same however the table is cut into files and partitions,
and so is every sample, draw and split that is decided by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textprep.sources.scratch import materialize

ROW_ID = "row_id"
#: Rows with more copies are spread over several tasks when they are written out again.
COPIES_PER_TASK = 65_536


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def content_key(columns: Sequence[str]) -> Column:
    """md5 of a row's values, each with its length; null differs from the empty string."""

    def part(name: str) -> Column:
        value = F.col(quoted(name)).cast("string")
        size = F.octet_length(value).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), value))

    return F.md5(F.concat(*[part(c) for c in columns]).cast("binary"))


def identified(
    df: DataFrame, name: str = ROW_ID, columns: Sequence[str] | None = None
) -> DataFrame:
    """``columns`` of ``df`` (all of them) and ``name``: ``<md5 of the values>-<number of the copy>``.

    Equal rows are counted, which combines them before the exchange however many there are, and
    written out again as often with numbers from 0. The result is stored.
    """
    columns = list(columns or df.columns)
    table = df.select(*[F.col(quoted(c)) for c in columns])
    counted = table.groupBy(*table.columns).agg(F.count(F.lit(1)).alias("_copies"))
    counted = materialize(counted.withColumn("_key", content_key(columns)), "counted")

    def copies(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        rows = rows.withColumn("_copy", F.explode(F.sequence(first, last)))
        id_ = F.concat_ws("-", "_key", F.col("_copy").cast("string"))
        return rows.select(*[F.col(quoted(c)) for c in columns], id_.alias(name))

    several = F.col("_copies") > COPIES_PER_TASK
    few = copies(counted.where(~several), F.lit(0).cast("long"), F.col("_copies") - 1)
    starts = F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES_PER_TASK).cast("long"))
    many = counted.where(several).withColumn("_start", F.explode(starts)).repartition("_key", "_start")
    end = F.least(F.col("_start") + COPIES_PER_TASK, F.col("_copies")) - 1
    return materialize(few.union(copies(many, F.col("_start"), end)), "identified")
