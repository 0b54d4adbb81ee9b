"""Label codes, table schemas and column checks shared by every job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, types as T

# Class names and codes of the labelled corpora.
NON_HOPE = "Non_hope_speech"
HOPE = "Hope_speech"
OTHER_LANGUAGE = {
    "english": "not-English",
    "tamil": "not-Tamil",
    "malayalam": "not-Malayalam",
}
LABEL_CODES = {NON_HOPE: 0, HOPE: 1}
BINARY_LABELS = (0, 1)
OTHER_CODE = 2


RAW_SCHEMA = T.StructType([T.StructField("raw", T.StringType())])

# The label is read as a double because a column holding nulls is stored as "1.0".
PARSED_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label_str", T.StringType()),
        T.StructField("label", T.DoubleType()),
    ]
)


def label_codes(language: str) -> dict[str, int]:
    """Class name -> code, with the third class named for ``language``."""
    return {**LABEL_CODES, OTHER_LANGUAGE[language.lower()]: OTHER_CODE}


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise ``ValueError`` naming the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def detect_text_and_label(columns: list[str]) -> tuple[str, str]:
    """Pick the text and the label column by name; the last match wins.

    Without a match the first column is the text and the last one the label.
    """
    text_matches = [c for c in columns if "text" in c.lower()]
    label_matches = [c for c in columns if "label" in c.lower() or "hope" in c.lower()]
    return (text_matches or columns[:1])[-1], (label_matches or columns)[-1]
