"""Inputs of the registered queries, each with its SQL twin.

The given tables hold no Indic text, no label lines and no hope phrases, so whole tables are
rewritten by rule into the shapes the operators work on. Every view keeps all rows.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textprep.functions import lexicons
from textprep.sources.files import spread

VIEWS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, key) if key else df


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id")


def conversations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations", "conv_id")


def with_views(*names: str) -> str:
    """``WITH`` clause for SQL views in the given order."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " "


# --- labelled corpus -------------------------------------------------------------------------

VIEWS["corpus"] = """
    SELECT d.doc_id, d.text, d.lang, d.source, l.quality AS label,
           CAST(l.toxic AS BIGINT) AS toxic_positivity
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def corpus(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.col("quality").alias("label"),
        F.col("toxic").cast("bigint").alias("toxic_positivity"),
    )
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return docs.join(labels, "doc_id", "left")


VIEWS["labelled"] = "SELECT * FROM corpus WHERE label IN (0, 1)"


def labelled(spark, sf_dir) -> DataFrame:
    return corpus(spark, sf_dir).where(F.col("label").isin(0, 1))


def classed(spark, sf_dir) -> DataFrame:
    """All documents; those without a label are the third class."""
    label = F.coalesce("label", F.lit(2)).alias("label")
    return corpus(spark, sf_dir).select("doc_id", "text", label, "toxic_positivity")


# --- "text;label;" lines; commas become ";;" so that texts hold separators and empty chunks ----


def _line_sql(other: str) -> str:
    return f"""
    SELECT doc_id, replace(replace(text, chr(10), ' '), ',', ';;') || ';'
        || CASE label WHEN 1 THEN 'Hope_speech;' WHEN 0 THEN 'Non_hope_speech;'
           ELSE '{other};' END AS raw
    FROM corpus"""


VIEWS["lines"] = _line_sql("not-English")
VIEWS["tamil_lines"] = _line_sql("not-Tamil").replace("FROM corpus", "FROM tamil_corpus")


def name_of(label: str, other: str) -> Column:
    return (
        F.when(F.col(label) == 1, "Hope_speech")
        .when(F.col(label) == 0, "Non_hope_speech")
        .otherwise(other)
    )


def as_lines(df: DataFrame, other: str) -> DataFrame:
    body = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(","), F.lit(";;"))
    raw = F.concat(body, F.lit(";"), name_of("label", other), F.lit(";"))
    return df.select("doc_id", raw.alias("raw"))


def lines(spark, sf_dir) -> DataFrame:
    return as_lines(corpus(spark, sf_dir), "not-English")


VIEWS["parsed_chunks"] = """
    SELECT doc_id, list_filter(string_split(raw, ';'), lambda x: x <> '') AS c FROM lines"""
VIEWS["parsed"] = """
    SELECT doc_id,
           CASE WHEN len(c) = 0 THEN '' WHEN len(c) = 1 THEN c[1]
                ELSE array_to_string(c[1:len(c) - 1], ';') END AS text,
           CASE WHEN len(c) > 1 THEN c[len(c)] END AS label_str,
           CASE WHEN len(c) > 1 THEN
               CASE c[len(c)] WHEN 'Non_hope_speech' THEN 0 WHEN 'Hope_speech' THEN 1
                    WHEN 'not-English' THEN 2 END END AS label
    FROM parsed_chunks"""


# --- a phrase chosen by id is appended to each text -------------------------------------------


def _pick(phrases) -> Column:
    index = F.pmod(F.col("doc_id"), F.lit(len(phrases))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(p) for p in phrases]), index)


def _pick_sql(phrases) -> str:
    quoted = ", ".join("'" + p.replace("'", "''") + "'" for p in phrases)
    return f"list_extract([{quoted}], CAST(doc_id % {len(phrases)} AS INTEGER) + 1)"


TAMIL_PHRASES = ["நம்பிக்கை இல்லை", "நம்பிக்கை", "இல்லை", "நம்பிக்கை மாட்டேன்", "இன்று மழை"]

VIEWS["tamil_corpus"] = f"""
    SELECT doc_id, {_pick_sql(TAMIL_PHRASES)} || ' ' || text AS text, label FROM corpus"""


def tamil_corpus(spark, sf_dir) -> DataFrame:
    text = F.concat_ws(" ", _pick(TAMIL_PHRASES), "text").alias("text")
    return corpus(spark, sf_dir).select("doc_id", text, "label")


def tamil_lines(spark, sf_dir) -> DataFrame:
    return as_lines(tamil_corpus(spark, sf_dir), "not-Tamil")


VIEWS["tamil_parsed"] = """
    SELECT doc_id, text,
           CASE label WHEN 1 THEN 'Hope_speech' WHEN 0 THEN 'Non_hope_speech'
                ELSE 'not-Tamil' END AS label_str,
           coalesce(label, 2) AS label
    FROM tamil_corpus"""


def tamil_parsed(spark, sf_dir) -> DataFrame:
    return tamil_corpus(spark, sf_dir).select(
        "doc_id",
        "text",
        name_of("label", "not-Tamil").alias("label_str"),
        F.coalesce("label", F.lit(2)).alias("label"),
    )


ENGLISH_PHRASES = [*lexicons.ENGLISH_POSITIVE, *lexicons.ENGLISH_NEGATIVE, "a plain remark"]
MALAYALAM_PHRASES = [*lexicons.MALAYALAM_POSITIVE, *lexicons.MALAYALAM_NEGATIVE, "നാളെ"]

VIEWS["scored"] = f"""
    SELECT doc_id, text || ' ' || upper({_pick_sql(ENGLISH_PHRASES)}) AS text,
           coalesce(label, 0) AS base_pred
    FROM corpus"""
VIEWS["scored_malayalam"] = f"""
    SELECT doc_id, text || ' ' || {_pick_sql(MALAYALAM_PHRASES)} AS text,
           coalesce(label, 0) AS base_pred
    FROM corpus"""


def scored(spark, sf_dir) -> DataFrame:
    return corpus(spark, sf_dir).select(
        "doc_id",
        F.concat_ws(" ", "text", F.upper(_pick(ENGLISH_PHRASES))).alias("text"),
        F.coalesce("label", F.lit(0)).alias("base_pred"),
    )


def scored_malayalam(spark, sf_dir) -> DataFrame:
    return corpus(spark, sf_dir).select(
        "doc_id",
        F.concat_ws(" ", "text", _pick(MALAYALAM_PHRASES)).alias("text"),
        F.coalesce("label", F.lit(0)).alias("base_pred"),
    )


VIEWS["marked"] = """
    SELECT doc_id, text || CASE label WHEN 1 THEN 'Hope_speech' WHEN 0 THEN 'Non_hope_speech'
           ELSE 'notmalayalam' END AS text
    FROM corpus"""


def marked(spark, sf_dir) -> DataFrame:
    text = F.concat("text", name_of("label", "notmalayalam")).alias("text")
    return corpus(spark, sf_dir).select("doc_id", text)


# --- untidy text: odd whitespace, links, mentions, decomposed accents --------------------------

_COMMA = " http://x.y/z?q=1 @me வ#tag_1, www.foo.com "

VIEWS["messy"] = f"""
    SELECT doc_id, lang,
           chr(160) || ' ' || replace(replace(text, '. ', '.' || chr(8195) || chr(9)), ', ',
           '{_COMMA}') || ' ' || chr(12288) AS text
    FROM documents"""


def untidy(text: Column | str = "text") -> Column:
    body = F.replace(text, F.lit(". "), F.lit("." + chr(8195) + chr(9)))
    body = F.replace(body, F.lit(", "), F.lit(_COMMA))
    return F.concat(F.lit(chr(160) + " "), body, F.lit(" " + chr(12288)))


def messy(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "lang", untidy().alias("text"))


# Precomposed letter -> base letter and combining mark.
_DECOMPOSED = {c: unicodedata.normalize("NFD", c) for c in map(chr, (0xE9, 0xF6, 0xF1, 0xE7))}


def _decompose(c: Column) -> Column:
    for letter, pair in _DECOMPOSED.items():
        c = F.replace(c, F.lit(letter), F.lit(pair))
    return c


def decompose_sql(c: str) -> str:
    for letter, pair in _DECOMPOSED.items():
        c = f"replace({c}, '{letter}', '{pair}')"
    return c


VIEWS["decomposed"] = f"SELECT doc_id, lang, {decompose_sql('text')} AS text FROM messy"


def decomposed(spark, sf_dir) -> DataFrame:
    return messy(spark, sf_dir).withColumn("text", _decompose(F.col("text")))


VIEWS["scripted"] = """
    SELECT doc_id, CASE doc_id % 4
        WHEN 0 THEN regexp_replace(text, '[A-Za-z]', 'ந', 'g')
        WHEN 1 THEN text
        WHEN 2 THEN replace(text, 'a', 'നാ')
        ELSE regexp_replace(text, '[A-Za-z]', '1', 'g') END AS text
    FROM documents"""


def scripted(spark, sf_dir) -> DataFrame:
    case = F.pmod("doc_id", F.lit(4))
    text = (
        F.when(case == 0, F.regexp_replace("text", "[A-Za-z]", "ந"))
        .when(case == 1, F.col("text"))
        .when(case == 2, F.replace("text", F.lit("a"), F.lit("നാ")))
        .otherwise(F.regexp_replace("text", "[A-Za-z]", "1"))
    )
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


# --- two sources: even-numbered ones are real, odd-numbered ones synthetic with one column more -

VIEWS["real"] = f"""
    SELECT doc_id, {decompose_sql('text')} AS text, lang, label
    FROM corpus WHERE CAST(substr(source, 4) AS INTEGER) % 2 = 0"""
VIEWS["synthetic"] = """
    SELECT doc_id, text, lang, label, toxic_positivity
    FROM corpus WHERE CAST(substr(source, 4) AS INTEGER) % 2 = 1"""
VIEWS["merged"] = """
    SELECT doc_id, text, lang, label, CAST(NULL AS BIGINT) AS toxic_positivity, 0 AS source_rank
    FROM real
    UNION ALL
    SELECT doc_id, text, lang, label, toxic_positivity, 1 AS source_rank FROM synthetic"""


def real_and_synthetic(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    base = corpus(spark, sf_dir)
    odd = F.substring("source", 4, 9).cast("int") % 2 == 1
    real = base.where(~odd).select(
        "doc_id", _decompose(F.col("text")).alias("text"), "lang", "label"
    )
    return real, base.where(odd).select("doc_id", "text", "lang", "label", "toxic_positivity")
