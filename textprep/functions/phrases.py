"""Phrase predicates and the rule override of a base prediction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F


def contains_any(c: Column | str, phrases: Sequence[str], ignore_case: bool = True) -> Column:
    """True where the text holds any phrase as a substring; null text -> false.

    Phrases are compared as given; with ``ignore_case`` only the text is lower-cased.
    """
    c = F.col(c) if isinstance(c, str) else c
    c = F.lower(c) if ignore_case else c
    hits = [c.contains(p) for p in phrases]
    return F.coalesce(reduce(or_, hits, F.lit(False)), F.lit(False))


def apply_rules(
    df: DataFrame,
    positive: Sequence[str],
    negative: Sequence[str],
    text: str = "text",
    base: str = "base_pred",
    first: str = "positive",
) -> DataFrame:
    """Override ``base`` by phrase rules; adds ``rule`` and ``final_pred``.

    The ``first`` rule set wins where both match, so "i don't have hope" is positive by default:
    it contains "have hope".
    """
    hits = {
        "positive": contains_any(text, positive),
        "negative": contains_any(text, negative),
    }
    second = "negative" if first == "positive" else "positive"
    rule = F.when(hits[first], first).when(hits[second], second).otherwise("none")
    final = (
        F.when(F.col("rule") == "positive", F.lit(1))
        .when(F.col("rule") == "negative", F.lit(0))
        .otherwise(F.col(base))
    )
    return df.withColumn("rule", rule).withColumn("final_pred", final)
