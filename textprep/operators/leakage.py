"""Leakage between splits: rows of one split whose normalized text also stands in another.

Texts meet by a 64-bit hash first, so what is exchanged is a hash and an id per row; only rows whose
hash occurs on the other side are compared by text. At scale Spark adds a Bloom filter of the smaller
side to these joins by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from textprep.functions.text import normalize_text
from textprep.sources.scratch import materialize


def leaked_rows(
    df: DataFrame,
    ids: Sequence[str],
    text: str = "text",
    split: str = "split",
    train: str = "train",
) -> DataFrame:
    """``ids, split`` of the rows outside ``train`` whose normalized text occurs in it.

    Blank texts leak nothing. ``ids`` name rows.
    """
    hashed = df.select(*ids, split, text, F.xxhash64(normalize_text(text)).alias("_hash"))
    is_train = F.col(split) == train
    known = hashed.where(is_train).select("_hash").distinct()
    suspects = hashed.where(~is_train).join(known, "_hash", "left_semi")
    suspects = materialize(suspects.select(*ids, split, "_hash", normalize_text(text).alias("_text")), "suspects")
    wanted = suspects.select("_hash").distinct()
    sources = hashed.where(is_train).join(wanted, "_hash", "left_semi")
    sources = sources.select("_hash", normalize_text(text).alias("_text")).distinct()
    leaked = suspects.where("_text <> ''").join(sources, ["_hash", "_text"], "left_semi")
    return leaked.select(*ids, split)


def leakage_report(
    df: DataFrame, ids: Sequence[str], text: str = "text", split: str = "split", train: str = "train"
) -> DataFrame:
    """Per split but ``train``: its rows and how many of them leak."""
    rows = df.where(F.col(split) != train).groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))
    leaked = leaked_rows(df, ids, text, split, train).groupBy(split).agg(F.count(F.lit(1)).alias("n_leaked"))
    return rows.join(leaked, split, "left").fillna(0, ["n_leaked"])


def without_leakage(
    df: DataFrame, ids: Sequence[str], text: str = "text", split: str = "split", train: str = "train"
) -> DataFrame:
    """``df`` without the rows of other splits that stand in ``train``."""
    leaked = materialize(leaked_rows(df, ids, text, split, train).select(*ids), "leaked")
    return df.join(leaked, list(ids), "left_anti")
