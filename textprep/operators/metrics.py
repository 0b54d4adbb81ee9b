"""Counts, class weights and classification metrics as small result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from textprep.operators.sampling import MAX_BROADCAST_CLASSES
from textprep.sources.files import materialize


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    if dropna:
        df = df.where(F.col(column).isNotNull())
    return df.groupBy(column).count().orderBy(F.desc("count"), column)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def class_weights(
    df: DataFrame, label: str = "label", classes: Sequence[int] | None = None
) -> DataFrame:
    """One row per class: ``n_rows`` and the balanced weight ``n / (k * n_class)``.

    Classes are all labels but null, or those given.
    """
    wanted = F.col(label).isNotNull() if classes is None else F.col(label).isin(*classes)
    counts = class_counts(df.where(wanted), label)
    every = Window.partitionBy()
    n = F.sum("n_rows").over(every)
    k = F.count(F.lit(1)).over(every)
    return counts.withColumn("weight", n / (k * F.col("n_rows")))


def with_class_weight(
    df: DataFrame, label: str = "label", classes: Sequence[int] | None = None
) -> DataFrame:
    """Attach ``weight``; rows whose label is no class are kept with a null weight.

    The joined table has one row per class. It is counted, and broadcast up to
    ``MAX_BROADCAST_CLASSES`` of them; beyond, it is stored, so that Spark can split a hot label.
    """
    weights = class_weights(df, label, classes).select(label, "weight")
    if classes is not None or weights.count() <= MAX_BROADCAST_CLASSES:
        return df.join(F.broadcast(weights), label, "left")
    return df.join(materialize(weights, "weights"), label, "left")


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


def value_counts_by(
    df: DataFrame, column: str, dims: Sequence[str], sets: Sequence[Sequence[str]]
) -> DataFrame:
    """Rows per value of ``column`` for several groupings at once: ``dims, grouping, column, n_rows``.

    ``sets`` lists subsets of ``dims``. ``grouping`` has a bit for each of ``dims``, the first one
    highest, which is 1 where the column is rolled up; so a total differs from a null group. The
    table is read once.
    """
    wanted = [[*dict.fromkeys([*s, column])] for s in sets]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in wanted], *dims, column)
    rolled = grouped.agg(F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("n_rows"))
    # The value itself is in every set; its bit is the last one.
    return rolled.select(*dims, F.shiftright("_id", 1).alias("grouping"), column, "n_rows")


def confusion(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    dims: Sequence[str] = (),
    sets: Sequence[Sequence[str]] = ((),),
) -> DataFrame:
    """Rows per label and prediction, for each grouping in ``sets`` of the columns ``dims``."""
    if not dims:
        return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n_rows"))
    wanted = [[F.col(c) for c in (*s, label, prediction)] for s in sets]
    grouped = df.groupingSets(wanted, *dims, label, prediction)
    rolled = grouped.agg(F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("n_rows"))
    return rolled.withColumn("grouping", F.shiftright("_id", 2)).drop("_id")


def classification_report(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    digits: int = 3,
    dims: Sequence[str] = (),
    sets: Sequence[Sequence[str]] = ((),),
) -> DataFrame:
    """Per-class precision, recall, f1 and support, plus accuracy, macro and weighted averages.

    A ratio with an empty denominator is 0. The data is read once, for the confusion counts; the
    rest works on at most k * k rows. With ``dims`` there is a report for every group of every
    grouping in ``sets``, such as per language, per split and in total, still from one reading;
    ``grouping`` tells them apart as in :func:`value_counts_by`.
    """
    by = [*dims, "grouping"] if dims else []
    n = F.col("n_rows")
    hit = F.when(F.col(label) == F.col(prediction), n).otherwise(0)
    zero = F.lit(0).cast("bigint")
    predicted = F.col(prediction).cast(df.schema[label].dataType)

    def part(cls, *counts):
        names = ("support", "predicted", "hits")
        return F.struct(cls.alias("cls"), *[c.alias(m) for c, m in zip(counts, names)])

    parts = F.array(part(F.col(label), n, zero, hit), part(predicted, zero, n, zero))
    per_class = (
        confusion(df, label, prediction, dims, sets)
        .select(*by, F.inline(parts))
        .groupBy(*by, "cls")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    per_class = per_class.withColumns(
        {
            "precision": ratio(F.col("hits"), F.col("predicted")),
            "recall": ratio(F.col("hits"), F.col("support")),
        }
    ).withColumn(
        "f1",
        ratio(
            2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
        ),
    )

    # Every class row also takes part in the three summary rows.
    rows = per_class.withColumn(
        "name",
        F.explode(
            F.array(
                F.col("cls").cast("string"),
                F.lit("accuracy"),
                F.lit("macro avg"),
                F.lit("weighted avg"),
            )
        ),
    )
    summary = []
    for metric in ("precision", "recall", "f1"):
        weighted = ratio(F.sum(F.col(metric) * F.col("support")), F.sum("support"))
        value = F.when(F.col("name") == "weighted avg", weighted)
        # "accuracy" is shown in the f1 column only.
        shown = F.sum("hits") / F.sum("support") if metric == "f1" else F.lit(None)
        value = value.when(F.col("name") == "accuracy", shown).otherwise(F.avg(metric))
        summary.append(F.round(value, digits).alias(metric))
    return rows.groupBy(*by, "name").agg(*summary, F.sum("support").alias("support"))
