"""The text and label functions as SQL functions.

``register`` defines temporary SQL functions from the same Column expressions that the jobs use, so
``SELECT clean_text(text, lang) FROM t`` is inlined and planned like the Column form: no user-defined
code runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, SparkSession

from textprep.functions import labels, scripts, text
from textprep.functions.lexicons import TAMIL_HOPE_WORD, TAMIL_NEGATIONS
from textprep.schema import label_codes


class SqlFunction(NamedTuple):
    """Parameter -> type, the type of the result, and the expression over the parameters' columns."""

    parameters: Mapping[str, str]
    returns: str
    expression: Callable[[], Column]


def _of_text(function: Callable[[str], Column], returns: str = "STRING") -> SqlFunction:
    return SqlFunction({"text": "STRING"}, returns, lambda: function("text"))


FUNCTIONS: dict[str, SqlFunction] = {
    "unicode_strip": _of_text(text.strip),
    "remove_urls": _of_text(text.remove_urls),
    "remove_mentions": _of_text(text.remove_mentions),
    "remove_symbols": _of_text(text.remove_symbols),
    "collapse_whitespace": _of_text(text.collapse_whitespace),
    "lower_for_language": SqlFunction(
        {"text": "STRING", "lang": "STRING"}, "STRING", lambda: text.lower_for_language("text", "lang")
    ),
    "clean_text": SqlFunction(
        {"text": "STRING", "lang": "STRING"}, "STRING", lambda: text.clean_text("text", "lang")
    ),
    "leaves_text": _of_text(text.leaves_text, "BOOLEAN"),
    "nfc": _of_text(text.nfc),
    "normalize_text": _of_text(text.normalize_text),
    "is_not_blank": _of_text(text.is_not_blank, "BOOLEAN"),
    "has_tamil": _of_text(lambda c: scripts.has_script(c, "tamil"), "BOOLEAN"),
    "has_malayalam": _of_text(lambda c: scripts.has_script(c, "malayalam"), "BOOLEAN"),
    "has_latin": _of_text(scripts.has_latin, "BOOLEAN"),
    "tamil_variant": _of_text(lambda c: scripts.script_variant(c, "tamil")),
    "malayalam_variant": _of_text(lambda c: scripts.script_variant(c, "malayalam")),
    "line_text": SqlFunction({"raw": "STRING"}, "STRING", lambda: labels.split_text_label("raw")[0]),
    "line_label": SqlFunction({"raw": "STRING"}, "STRING", lambda: labels.split_text_label("raw")[1]),
    **{
        f"{language}_label_code": SqlFunction(
            {"label_str": "STRING"}, "INT", lambda codes=label_codes(language): labels.map_label("label_str", codes)
        )
        for language in ("english", "tamil", "malayalam")
    },
    "hope_label": SqlFunction({"label": "STRING"}, "INT", lambda: labels.encode_label("label")),
    "marked_label": _of_text(labels.derive_label),
    "without_marker": _of_text(labels.strip_label_suffix),
    "is_negated_hope": SqlFunction(
        {"text": "STRING", "label_str": "STRING"}, "BOOLEAN",
        lambda: labels.relabel_mask(TAMIL_HOPE_WORD, TAMIL_NEGATIONS),
    ),
}


def expression_sql(spark: SparkSession, function: SqlFunction) -> str:
    """The expression as Spark's analyzer writes it."""
    schema = ", ".join(f"{name} {kind}" for name, kind in function.parameters.items())
    table = spark.createDataFrame([], schema).select(function.expression().alias("value"))
    return table._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession, names: Mapping[str, SqlFunction] = FUNCTIONS) -> list[str]:
    """Define the functions in the session; returns their names."""
    for name, function in names.items():
        parameters = ", ".join(f"{p} {kind}" for p, kind in function.parameters.items())
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {function.returns} "
            f"RETURN {expression_sql(spark, function)}"
        )
    return list(names)
