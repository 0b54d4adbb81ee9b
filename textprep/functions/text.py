"""Unicode text functions as Column expressions. None of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Regex classes equal to Python's str patterns: \s is the Unicode White_Space property plus the
# four ASCII separators; \w is letters, numbers and underscore but no combining marks.
SPACE = r"\p{IsWhite_Space}\x{1c}-\x{1f}"
WORD = r"\p{L}\p{N}_"

# The characters str.strip() removes, derived by rule. None lies above U+3000.
_STRIP_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

TAMIL_BLOCK = (0x0B80, 0x0BFF)
MALAYALAM_BLOCK = (0x0D00, 0x0D7F)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Unicode strip on both ends; ``trim`` alone would remove only U+0020."""
    return F.btrim(_column(c), F.lit(_STRIP_CHARS))


def collapse_whitespace(c: Column | str) -> Column:
    """Replace each whitespace run by one space.

    Lone plain spaces, the common case, are not matched, so most of a text is copied untouched.
    """
    return F.regexp_replace(_column(c), f"[{SPACE}]{{2,}}|[{SPACE}&&[^ ]]", " ")


def remove_urls(c: Column | str) -> Column:
    return F.regexp_replace(_column(c), f"http[^{SPACE}]+|www[^{SPACE}]+", "")


def remove_mentions(c: Column | str) -> Column:
    """Remove ``@name`` and ``#tag``."""
    return F.regexp_replace(_column(c), f"[@#][{WORD}]+", "")


def block_class(blocks) -> str:
    """Inside of a regex class that covers the given ``(first, last)`` code point ranges."""
    return "".join(f"\\x{{{first:04x}}}-\\x{{{last:04x}}}" for first, last in blocks)


def remove_symbols(c: Column | str, keep_blocks=(MALAYALAM_BLOCK, TAMIL_BLOCK)) -> Column:
    """Keep word characters, whitespace and whole ``keep_blocks`` (for their vowel signs)."""
    return F.regexp_replace(_column(c), f"[^{WORD}{SPACE}{block_class(keep_blocks)}]+", "")


def lower_for_language(c: Column | str, lang: Column | str, language: str = "english") -> Column:
    """Lower-case rows whose ``lang`` column names ``language``, so one job serves many languages."""
    c = _column(c)
    return F.when(F.lower(_column(lang)) == language, F.lower(c)).otherwise(c)


def clean_text(
    c: Column | str,
    lang: Column | str,
    language: str = "english",
    keep_blocks=(MALAYALAM_BLOCK, TAMIL_BLOCK),
) -> Column:
    """Strip, drop URLs, mentions and symbols, collapse whitespace, lower-case by language, strip."""
    c = remove_mentions(remove_urls(strip(c)))
    c = collapse_whitespace(remove_symbols(c, keep_blocks))
    return strip(lower_for_language(c, lang, language))


def leaves_text(c: Column | str, keep_blocks=(MALAYALAM_BLOCK, TAMIL_BLOCK)) -> Column:
    """True where :func:`clean_text` leaves more than whitespace.

    A filter on the cleaned column would be pushed below it and clean every text twice. Nearly
    always an early character settles it: one that is kept, with nothing before it that could
    begin a URL or a mention. Only the other texts are cleaned for the test.
    """
    c = _column(c)
    kept = f"{WORD}{block_class(keep_blocks)}"
    early = c.rlike(f"^[^@#hw]*?[{kept}&&[^hw]]")
    rest = remove_symbols(remove_mentions(remove_urls(strip(c))), keep_blocks)
    return F.when(early, F.lit(True)).otherwise(is_not_blank(rest))


def nfc(c: Column | str) -> Column:
    """Unicode NFC through the ICU library that Spark ships; ASCII values are passed through."""
    c = _column(c)
    composed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False)
    )
    return F.when(c.rlike(r"[^\x00-\x7f]"), composed).otherwise(c)


def normalize_text(c: Column | str) -> Column:
    """NFC, strip, collapse whitespace; null becomes the empty string."""
    return collapse_whitespace(strip(F.coalesce(nfc(c), F.lit(""))))


def is_not_blank(c: Column | str) -> Column:
    return F.length(strip(c)) > 0
