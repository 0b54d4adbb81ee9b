"""Fixed-length id sequences for a transformer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textprep.operators.features import fit_vocabulary, vocabulary_table, word_tokens
from textprep.sources.scratch import materialize

MAX_LENGTH = 128

# Ids of the special tokens.
START_ID, PAD_ID, END_ID, UNKNOWN_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4


def piece_tokens(c: Column | str) -> Column:
    """Words for encoding: one character is enough, and vowel signs stay in their word."""
    return word_tokens(c, min_chars=1, keep_marks=True)


def fit_ids(df: DataFrame, text: str = "text", size: int = 5000) -> DataFrame:
    """Corpus vocabulary ``term, id``: the most frequent words, ids from 4 by rank."""
    tokens = materialize(df.select(piece_tokens(text).alias("tokens")), "pieces")
    vocabulary = fit_vocabulary(tokens, "tokens", size, max_n=1)
    ids = (F.col("idx") + FIRST_WORD_ID).alias("id")
    return vocabulary_table(df.sparkSession, vocabulary).select("term", ids)


def pad(ids: Column, max_length: int = MAX_LENGTH) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID), max_length - F.size(ids)))


def attention_mask(ids: Column, max_length: int = MAX_LENGTH) -> Column:
    """1 for each id of the unpadded sequence, 0 up to ``max_length``; array<tinyint>."""
    one, zero = F.lit(1).cast("tinyint"), F.lit(0).cast("tinyint")
    return F.concat(
        F.array_repeat(one, F.size(ids)), F.array_repeat(zero, max_length - F.size(ids))
    )


def encode_ids(
    df: DataFrame,
    ids: DataFrame,
    doc_id: str,
    text: str = "text",
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """Replace ``text`` by ``input_ids`` and ``attention_mask``; other columns are kept.

    Texts longer than ``max_length`` minus two special tokens are truncated, as the model needs.
    ``ids`` is a vocabulary of fixed size, so it is broadcast. Rows are placed by ``doc_id`` after
    truncation and numbered there, so rows that share an id stay apart; collecting the ids of a row
    (at most ``max_length``) then needs no exchange.
    """
    keep = [c for c in df.columns if c not in (doc_id, text)]
    words = F.slice(piece_tokens(F.coalesce(text, F.lit(""))), 1, max_length - 2)
    kept = F.struct(F.lit(0).alias("_none"), *keep).alias("_kept")
    placed = df.select(doc_id, kept, words.alias("_words")).repartition(doc_id)
    placed = placed.withColumn("_row", F.monotonically_increasing_id())
    numbered = placed.select(
        doc_id, "_row", "_kept", F.posexplode_outer("_words").alias("_pos", "term")
    )
    looked_up = numbered.join(F.broadcast(ids), "term", "left")
    word_id = F.when(F.col("_pos").isNotNull(), F.coalesce("id", F.lit(UNKNOWN_ID)))
    entry = F.when(F.col("_pos").isNotNull(), F.struct("_pos", word_id.alias("id")))
    grouped = looked_up.groupBy(doc_id, "_row").agg(
        F.first("_kept").alias("_kept"), F.collect_list(entry).alias("_entries")
    )
    grouped = grouped.select(doc_id, "_kept.*", "_entries").drop("_none")
    sequence = F.concat(
        F.array(F.lit(START_ID)), F.array_sort("_entries")["id"], F.array(F.lit(END_ID))
    )
    return (
        grouped.withColumn("_ids", sequence)
        .withColumn("input_ids", pad(F.col("_ids"), max_length))
        .withColumn("attention_mask", attention_mask(F.col("_ids"), max_length))
        .drop("_entries", "_ids")
    )


def map_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Apply ``fn`` to Arrow batches: the hook for a tokenizer of the user's own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
