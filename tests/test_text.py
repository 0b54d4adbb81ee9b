import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from textprep.functions import scripts, text as tx

SAMPLES = [
    "  Hope, is here!! http://x.y/z @me #tag www.foo.com  ok ",
    "நம்பிக்கை இல்லை \U0001f600!",
    "not-Malayalam;",
    "café naïve",
    "  tabs\tand　more \x1c",
    "@http://joined tail",
    "a@b#c www",
    "ആശ ഇല്ല!",
    "é café",
    "",
    "   \t\n ",
    "#only @mentions http://only",
    "h w hw",
    "@a",
    "​ zero width",
]


# Expected results by input: cleaned (case kept), normalized.
EXPECTED = [
    ("Hope is here ok", "Hope, is here!! http://x.y/z @me #tag www.foo.com ok"),
    ("நம்பிக்கை இல்லை", "நம்பிக்கை இல்லை \U0001f600!"),
    ("notMalayalam", "not-Malayalam;"),
    ("café naïve", "café naïve"),
    ("tabs and more", "tabs and more"),
    ("tail", "@http://joined tail"),
    ("a www", "a@b#c www"),
    ("ആശ ഇല്ല", "ആശ ഇല്ല!"),
    ("e cafe", "é café"),
    ("", ""),
    ("", ""),
    ("", "#only @mentions http://only"),
    ("h w hw", "h w hw"),
    ("", "@a"),
    ("zero width", "\u200b zero width"),
]


def keeps_only_words(text):
    """What cleaning leaves: words, Indic signs and single inner spaces."""
    previous = " "
    for c in text:
        word = c == "_" or unicodedata.category(c)[0] in "LN"
        block = 0x0D00 <= ord(c) <= 0x0D7F or 0x0B80 <= ord(c) <= 0x0BFF
        if not (word or block or (c == " " and previous != " ")):
            return False
        previous = c
    return previous != " " or text == ""


def test_clean_text(apply):
    got = apply(lambda c: tx.clean_text(c, F.lit("malayalam")), SAMPLES)
    assert got == [cleaned for cleaned, _ in EXPECTED]
    got = apply(lambda c: tx.clean_text(c, F.lit("english")), SAMPLES)
    assert got == [cleaned.lower() for cleaned, _ in EXPECTED]


def test_clean_examples(apply):
    got = apply(lambda c: tx.clean_text(c, F.lit("malayalam")), SAMPLES[:4])
    assert got == ["Hope is here ok", "நம்பிக்கை இல்லை", "notMalayalam", "café naïve"]


def test_leaves_text_agrees_with_cleaning(apply):
    cleaned = apply(lambda c: tx.clean_text(c, F.lit("x")), SAMPLES)
    assert apply(tx.leaves_text, SAMPLES) == [c != "" for c in cleaned]


def test_normalize_and_null(apply):
    got = apply(tx.normalize_text, [*SAMPLES, None])
    assert got == [*[normalized for _, normalized in EXPECTED], ""]


def test_strip_every_space_character(apply):
    spaces = [chr(i) for i in range(0x3100) if chr(i).isspace() or chr(i) in "​﻿"]
    values = [f"{c}x{c}" for c in spaces]
    assert apply(tx.strip, values) == [v.strip() for v in values]
    assert apply(tx.collapse_whitespace, values) == [re.sub(r"\s+", " ", v) for v in values]


def test_nfc_of_every_character(spark):
    chars = [chr(i) for i in range(0x30000) if not 0xD800 <= i <= 0xDFFF]
    values = [unicodedata.normalize("NFD", c) + "x" + c for c in chars]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = df.select("i", tx.nfc("v").alias("n")).orderBy("i").toPandas()["n"].tolist()
    assert got == [unicodedata.normalize("NFC", v) for v in values]


ALPHABET = st.sampled_from(list("ab hw@#.-_\t éன்ി́İ1　") + ["http", "www", "://"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(ALPHABET, max_size=14).map("".join), min_size=20, max_size=60))
def test_text_functions_on_random_strings(apply, values):
    def clean(c):
        return tx.clean_text(c, F.lit("malayalam"))

    cleaned = apply(clean, values)
    assert all(keeps_only_words(c) for c in cleaned)
    assert apply(clean, [f"{v} http://{v}" for v in ("a", "b")]) == ["a", "b"]
    assert apply(tx.leaves_text, values) == [c != "" for c in cleaned]
    normalized = apply(tx.normalize_text, values)
    assert apply(tx.normalize_text, normalized) == normalized
    for value, result in zip(values, normalized):
        assert result.split() == unicodedata.normalize("NFC", value).split()
        assert result == " ".join(result.split())


@pytest.mark.parametrize(
    "value, tamil, malayalam",
    [
        ("நல்ல நாள்", "native", "unknown"),
        ("nalla naal", "romanized", "romanized"),
        ("நல்ல day", "mixed", "romanized"),
        ("123", "unknown", "unknown"),
        ("ആശ", "unknown", "native"),
        ("é", "unknown", "unknown"),
        (None, "unknown", "unknown"),
    ],
)
def test_script_variant(apply, value, tamil, malayalam):
    assert apply(scripts.script_variant, [value], "tamil") == [tamil]
    assert apply(scripts.script_variant, [value], "malayalam") == [malayalam]


def test_char_range_bounds(apply):
    values = ["୿", "஀", "௿", "ఀ", ""]
    assert apply(scripts.has_script, values, "tamil") == [False, True, True, False, False]


def test_lower_for_language(spark):
    df = spark.createDataFrame([("AbC", "English"), ("AbC", "tamil"), ("AbC", None)], "t string, l string")
    got = [r[0] for r in df.select(tx.lower_for_language("t", "l")).collect()]
    assert got == ["abc", "AbC", "AbC"]
