"""Script tests and script-variant tags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from textprep.functions.text import MALAYALAM_BLOCK, TAMIL_BLOCK, block_class

SCRIPT_BLOCKS = {"tamil": TAMIL_BLOCK, "malayalam": MALAYALAM_BLOCK}


def has_char_in_range(c: Column | str, first: int, last: int) -> Column:
    """True where any code point lies in ``first..last``; null text counts as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(f"[{block_class([(first, last)])}]"), F.lit(False))


def has_script(c: Column | str, script: str) -> Column:
    return has_char_in_range(c, *SCRIPT_BLOCKS[script])


def has_latin(c: Column | str) -> Column:
    """ASCII letters only: they stand for romanized writing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike("[A-Za-z]"), F.lit(False))


def script_variant(c: Column | str, script: str | tuple[int, int]) -> Column:
    """``native``, ``romanized``, ``mixed`` or ``unknown`` for a named script or a block."""
    block = SCRIPT_BLOCKS[script] if isinstance(script, str) else script
    native, latin = has_char_in_range(c, *block), has_latin(c)
    return (
        F.when(native, F.when(latin, "mixed").otherwise("native"))
        .when(latin, "romanized")
        .otherwise("unknown")
    )


def script_variant_by_language(
    c: Column | str, lang: Column | str, scripts: Mapping[str, str | tuple[int, int]]
) -> Column:
    """The variant for the script of each row's language; null for languages without one."""
    lang = F.col(lang) if isinstance(lang, str) else lang
    return F.coalesce(
        *[F.when(lang == code, script_variant(c, script)) for code, script in scripts.items()],
        F.lit(None).cast("string"),
    )
