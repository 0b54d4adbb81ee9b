"""Parsing and mapping of labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textprep.functions.phrases import contains_any
from textprep.functions.text import strip
from textprep.schema import HOPE, LABEL_CODES, NON_HOPE


def split_text_label(raw: Column | str) -> tuple[Column, Column]:
    """``text;label;`` -> (text, label_str).

    Empty chunks are dropped. With two or more chunks the last one is the label and the others
    are joined by ``;`` again. One chunk is a text without label; no chunk is the empty text.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    chunks = F.array_remove(F.split(F.coalesce(raw, F.lit("")), ";"), "")
    n = F.size(chunks)
    n_text = n - F.when(n > 1, 1).otherwise(0)
    text = F.array_join(F.slice(chunks, F.lit(1), n_text), ";")
    label = F.when(n > 1, F.element_at(chunks, -1))
    return text, label


def map_label(label_str: Column | str, codes: Mapping[str, int]) -> Column:
    """Class name -> code; unknown names and null -> null."""
    label_str = F.col(label_str) if isinstance(label_str, str) else label_str
    mapped = F.lit(None).cast("int")
    for name, code in codes.items():
        mapped = F.when(label_str == name, F.lit(code)).otherwise(mapped)
    return mapped


def encode_label(label: Column | str, keyword: str = "hope") -> Column:
    """1 where the lower-cased label contains ``keyword``, else 0.

    ``Non_hope_speech`` therefore becomes 1 too; use :func:`map_label` for the exact codes.
    """
    return F.coalesce(F.lower(strip(label)).contains(keyword).cast("int"), F.lit(0))


# Markers left inside cleaned text, most specific first, and the class they name.
MALAYALAM_MARKERS = (
    ("notmalayalam", "not-Malayalam"),
    ("Non_hope_speech", "Non_hope_speech"),
    ("Hope_speech", "Hope_speech"),
)


def derive_label(
    text: Column | str, markers: Sequence[tuple[str, str]] = MALAYALAM_MARKERS
) -> Column:
    """Name of the first marker found in the text, else null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.when(text.contains(marker), name) for marker, name in markers])


def strip_label_suffix(
    text: Column | str, markers: Sequence[tuple[str, str]] = MALAYALAM_MARKERS
) -> Column:
    """The text without the markers that name its class, wherever they stand.

    A model trained on marked texts sees its own label; one trained on these does not.
    """
    text = F.col(text) if isinstance(text, str) else text
    for marker, _ in markers:
        text = F.replace(text, F.lit(marker), F.lit(""))
    return strip(text)


def relabel_mask(
    word: str,
    negations: Sequence[str],
    from_name: str = HOPE,
    text: str = "text",
    label_str: str = "label_str",
) -> Column:
    """Rows of class ``from_name`` whose text has ``word`` and any of ``negations``."""
    mask = (
        (F.col(label_str) == from_name)
        & F.col(text).contains(word)
        & contains_any(text, negations, ignore_case=False)
    )
    return F.coalesce(mask, F.lit(False))


def relabel(df: DataFrame, mask: Column, to_name: str = NON_HOPE, codes=LABEL_CODES) -> DataFrame:
    """Set ``label_str`` and ``label`` to ``to_name`` where ``mask`` holds."""
    return df.withColumns(
        {
            "label_str": F.when(mask, F.lit(to_name)).otherwise(F.col("label_str")),
            "label": F.when(mask, F.lit(codes[to_name])).otherwise(F.col("label")),
        }
    )


def count_where(df: DataFrame, mask: Column, name: str = "affected") -> DataFrame:
    """One row with the number of rows a rule touches."""
    return df.agg(F.count_if(mask).alias(name))
