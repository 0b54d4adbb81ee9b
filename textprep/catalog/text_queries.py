"""Text functions, script tests, phrase predicates and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.catalog import inputs
from textprep.catalog.inputs import with_views
from textprep.catalog.registry import query
from textprep.functions import lexicons, phrases, scripts, sql, text as tx
from textprep.operators.metrics import value_counts as count_values

SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD = r"\p{L}\p{N}_"


def sql_sub(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, '{pattern}', '{by}', 'g')"


def sql_strip(c: str) -> str:
    return sql_sub(c, f"^[{SPACE}]+|[{SPACE}]+$")


def sql_collapse(c: str) -> str:
    return sql_sub(c, f"[{SPACE}]+", " ")


def sql_urls(c: str) -> str:
    return sql_sub(c, f"http[^{SPACE}]+|www[^{SPACE}]+")


def sql_mentions(c: str) -> str:
    return sql_sub(c, f"[@#][{WORD}]+")


def sql_symbols(c: str) -> str:
    return sql_sub(c, rf"[^{WORD}{SPACE}\x{{0D00}}-\x{{0D7F}}\x{{0B80}}-\x{{0BFF}}]")


def sql_clean(c: str, lower_if: str) -> str:
    c = sql_collapse(sql_symbols(sql_mentions(sql_urls(sql_strip(c)))))
    return sql_strip(f"CASE WHEN {lower_if} THEN lower({c}) ELSE {c} END")


def sql_normalize(c: str) -> str:
    return sql_collapse(sql_strip(f"nfc_normalize(coalesce({c}, ''))"))


def sql_any(c: str, items) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p.replace(chr(39), chr(39) * 2)}')" for p in items) + ")"


def _select(view: str, expr: str, name: str = "text", needs=()) -> str:
    return with_views(*needs, view) + f"SELECT doc_id, {expr} AS {name} FROM {view}"


@query(_select("messy", sql_strip("text")))
def strip_ws(spark, sf_dir):
    return inputs.messy(spark, sf_dir).select("doc_id", tx.strip("text").alias("text"))


@query(_select("messy", sql_collapse("text")))
def collapse_ws(spark, sf_dir):
    df = inputs.messy(spark, sf_dir)
    return df.select("doc_id", tx.collapse_whitespace("text").alias("text"))


@query(_select("messy", sql_urls("text")))
def remove_urls(spark, sf_dir):
    return inputs.messy(spark, sf_dir).select("doc_id", tx.remove_urls("text").alias("text"))


@query(_select("messy", sql_mentions("text")))
def remove_mentions(spark, sf_dir):
    return inputs.messy(spark, sf_dir).select("doc_id", tx.remove_mentions("text").alias("text"))


@query(_select("messy", sql_symbols("text")))
def remove_symbols(spark, sf_dir):
    return inputs.messy(spark, sf_dir).select("doc_id", tx.remove_symbols("text").alias("text"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN lower(text) ELSE text END AS text FROM documents")
def lower_by_lang(spark, sf_dir):
    df = inputs.documents(spark, sf_dir)
    return df.select("doc_id", tx.lower_for_language("text", "lang", "en").alias("text"))


@query(_select("messy", sql_clean("text", "lang = 'en'")))
def clean_text(spark, sf_dir):
    df = inputs.messy(spark, sf_dir)
    return df.select("doc_id", tx.clean_text("text", "lang", "en").alias("text"))


@query(
    "SELECT page_id, " + sql_clean("html || ' ' || url", "true") + " AS text FROM pages"
)
def clean_web_text(spark, sf_dir):
    df = inputs.table(spark, sf_dir, "pages", "page_id")
    raw = F.concat_ws(" ", "html", "url")
    return df.select("page_id", tx.clean_text(raw, F.lit("english")).alias("text"))


@query(_select("decomposed", sql_normalize("text"), needs=["messy"]))
def normalize_text(spark, sf_dir):
    df = inputs.decomposed(spark, sf_dir)
    return df.select("doc_id", tx.normalize_text("text").alias("text"))


@query(
    "SELECT conv_id, turn, text FROM conversations WHERE length("
    + sql_strip("regexp_replace(text, '[A-Z]', ' ', 'g')")
    + ") > 0"
)
def drop_empty_text(spark, sf_dir):
    df = inputs.conversations(spark, sf_dir).select("conv_id", "turn", "text")
    return df.where(tx.is_not_blank(F.regexp_replace("text", "[A-Z]", " ")))


@query(
    "SELECT doc_id, regexp_matches(text, '[\\x{c0}-\\x{24f}]') AS in_range FROM documents"
)
def script_range(spark, sf_dir):
    df = inputs.documents(spark, sf_dir)
    return df.select("doc_id", scripts.has_char_in_range("text", 0xC0, 0x24F).alias("in_range"))


_TA, _ML, _EN = (
    f"regexp_matches(text, '[{c}]')"
    for c in (r"\x{0B80}-\x{0BFF}", r"\x{0D00}-\x{0D7F}", "A-Za-z")
)


@query(
    with_views("scripted")
    + f"SELECT doc_id, {_TA} AS tamil, {_ML} AS malayalam, {_EN} AS latin FROM scripted"
)
def script_tests(spark, sf_dir):
    return inputs.scripted(spark, sf_dir).select(
        "doc_id",
        scripts.has_script("text", "tamil").alias("tamil"),
        scripts.has_script("text", "malayalam").alias("malayalam"),
        scripts.has_latin("text").alias("latin"),
    )


def sql_variant(native: str) -> str:
    return (
        f"CASE WHEN {native} AND {_EN} THEN 'mixed' WHEN {native} THEN 'native' "
        f"WHEN {_EN} THEN 'romanized' ELSE 'unknown' END"
    )


@query(
    with_views("scripted")
    + f"SELECT doc_id, {sql_variant(_TA)} AS tamil, {sql_variant(_ML)} AS malayalam FROM scripted"
)
def script_variant(spark, sf_dir):
    return inputs.scripted(spark, sf_dir).select(
        "doc_id",
        scripts.script_variant("text", "tamil").alias("tamil"),
        scripts.script_variant("text", "malayalam").alias("malayalam"),
    )


@query(
    with_views("corpus", "scored")
    + f"SELECT doc_id, {sql_any('lower(text)', lexicons.ENGLISH_NEGATIVE)} AS hit FROM scored"
)
def contains_any(spark, sf_dir):
    hit = phrases.contains_any("text", lexicons.ENGLISH_NEGATIVE)
    return inputs.scored(spark, sf_dir).select("doc_id", hit.alias("hit"))


@query(
    with_views("corpus", "tamil_corpus")
    + f"SELECT doc_id, {sql_any('text', lexicons.TAMIL_NEGATIONS)} AS negated, "
    + f"contains(text, '{lexicons.TAMIL_HOPE_WORD}') AS has_word FROM tamil_corpus"
)
def has_negation(spark, sf_dir):
    negated = phrases.contains_any("text", lexicons.TAMIL_NEGATIONS, ignore_case=False)
    has_word = phrases.contains_any("text", [lexicons.TAMIL_HOPE_WORD], ignore_case=False)
    df = inputs.tamil_corpus(spark, sf_dir)
    return df.select("doc_id", negated.alias("negated"), has_word.alias("has_word"))


def sql_rules(view: str, positive, negative, first: str = "positive") -> str:
    hits = {
        "positive": sql_any("lower(text)", positive),
        "negative": sql_any("lower(text)", negative),
    }
    second = "negative" if first == "positive" else "positive"
    return (
        with_views("corpus", view)
        + f", ruled AS (SELECT doc_id, base_pred, CASE WHEN {hits[first]} THEN '{first}' "
        f"WHEN {hits[second]} THEN '{second}' ELSE 'none' END AS rule FROM {view}) "
    )


_FINAL = (
    "SELECT doc_id, base_pred, CASE rule WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 "
    "ELSE base_pred END AS final_pred, rule FROM ruled"
)
_ENGLISH = (lexicons.ENGLISH_POSITIVE, lexicons.ENGLISH_NEGATIVE)
_MALAYALAM = (lexicons.MALAYALAM_POSITIVE, lexicons.MALAYALAM_NEGATIVE)


@query(sql_rules("scored", *_ENGLISH) + _FINAL)
def rule_override(spark, sf_dir):
    return phrases.apply_rules(inputs.scored(spark, sf_dir), *_ENGLISH).drop("text")


@query(sql_rules("scored", *_ENGLISH, first="negative") + _FINAL)
def rule_override_negative_first(spark, sf_dir):
    df = phrases.apply_rules(inputs.scored(spark, sf_dir), *_ENGLISH, first="negative")
    return df.drop("text")


@query(
    sql_rules("scored_malayalam", *_MALAYALAM)
    + _FINAL.replace("base_pred, CASE", "CASE").replace(", rule FROM", " FROM")
)
def rule_override_malayalam(spark, sf_dir):
    df = phrases.apply_rules(inputs.scored_malayalam(spark, sf_dir), *_MALAYALAM)
    return df.select("doc_id", "final_pred")


@query(sql_rules("scored", *_ENGLISH) + "SELECT rule, count(*) AS count FROM ruled GROUP BY rule")
def rule_counts(spark, sf_dir):
    return count_values(phrases.apply_rules(inputs.scored(spark, sf_dir), *_ENGLISH), "rule")


# --- the functions in SQL text -----------------------------------------------------------------


@query(
    with_views("messy") + "SELECT doc_id, " + sql_normalize("text") + " AS normalized, "
    + sql_clean("text", "lang = 'en'") + " AS text FROM messy"
)
def sql_text_functions(spark, sf_dir):
    sql.register(spark)
    lang = "if(lang = 'en', 'english', lang)"
    return spark.sql(
        f"SELECT doc_id, normalize_text(text) AS normalized, clean_text(text, {lang}) AS text FROM {{messy}}",
        messy=inputs.messy(spark, sf_dir),
    )


@query(
    with_views("corpus", "lines", "parsed_chunks", "parsed")
    + "SELECT doc_id, text, label_str, label, CAST(coalesce(contains(lower(label_str), 'hope'), false) "
    "AS INTEGER) AS hope FROM parsed"
)
def sql_label_functions(spark, sf_dir):
    sql.register(spark)
    return spark.sql(
        "SELECT doc_id, line_text(raw) AS text, line_label(raw) AS label_str, "
        "english_label_code(line_label(raw)) AS label, hope_label(line_label(raw)) AS hope FROM {lines}",
        lines=inputs.lines(spark, sf_dir),
    )
