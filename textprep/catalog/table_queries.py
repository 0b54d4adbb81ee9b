"""Parsing, labels, sources, set operations, metrics and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.catalog import inputs
from textprep.catalog.inputs import with_views
from textprep.catalog.registry import query
from textprep.catalog.text_queries import sql_any, sql_clean, sql_normalize, sql_strip, sql_variant
from textprep.functions import labels, lexicons
from textprep.functions.text import normalize_text
from textprep.operators import combine, leakage, metrics, sampling
from textprep.plans import jobs
from textprep.schema import label_codes, require_columns
from textprep.sources import files

PARSED = ("corpus", "lines", "parsed_chunks", "parsed")

# --- sources and sinks -------------------------------------------------------------------------


@query(with_views("corpus", "lines") + "SELECT raw FROM lines")
def read_lines(spark, sf_dir):
    path = files.scratch_path(spark, "lines")
    inputs.lines(spark, sf_dir).select("raw").write.text(path)
    return files.read_text_lines(spark, path)


@query(with_views("corpus", "lines") + "SELECT raw FROM lines")
def read_quoted_lines(spark, sf_dir):
    path = files.scratch_path(spark, "quoted-lines")
    doubled = F.replace("raw", F.lit('"'), F.lit('""'))
    quoted = F.concat(F.lit('"'), doubled, F.lit('"')).alias("value")
    inputs.lines(spark, sf_dir).select(quoted).write.text(path)
    return files.read_lines(spark, path)


@query(with_views("corpus") + "SELECT doc_id, text, lang, label FROM corpus")
def csv_roundtrip(spark, sf_dir):
    path = files.scratch_path(spark, "csv")
    columns = ["doc_id", "text", "lang", "label"]
    files.write_csv(inputs.corpus(spark, sf_dir).select(*columns), path)
    return files.load_checked(spark, path, schema="doc_id long, text string, lang string, label int")


@query(
    with_views("corpus")
    + "SELECT doc_id, text, CASE WHEN label IS NULL THEN 'test' ELSE 'train' END AS split FROM corpus"
)
def splits_roundtrip(spark, sf_dir):
    path = files.scratch_path(spark, "splits")
    split = F.when(F.col("label").isNull(), "test").otherwise("train")
    files.write_splits(inputs.corpus(spark, sf_dir).withColumn("split", split), path)
    return files.read_split(spark, path, columns=["doc_id", "text", "split"])


@query(with_views("corpus", "labelled") + "SELECT doc_id, label FROM labelled")
def read_model_columns(spark, sf_dir):
    path = files.scratch_path(spark, "columns")
    split = F.when(F.col("label").isNull(), "test").otherwise("train")
    files.write_splits(inputs.corpus(spark, sf_dir).withColumn("split", split), path)
    return files.read_split(spark, path, "train", ["doc_id", "label"])


@query(with_views("corpus") + "SELECT doc_id, text, label FROM corpus UNION ALL SELECT doc_id, text, label FROM corpus")
def optional_source(spark, sf_dir):
    """A table that is there is read; an absent one falls back to the corpus."""
    columns = ["doc_id", "text", "label"]
    corpus, path = inputs.corpus(spark, sf_dir).select(*columns), files.scratch_path(spark, "present")
    files.write_csv(corpus, path)
    schema = "doc_id long, text string, label int"
    present = files.load_optional(spark, path, schema=schema)
    absent = files.load_optional(spark, files.scratch_path(spark, "absent"), schema=schema)
    tables = [corpus if t is None else t for t in (present, absent)]
    return tables[0].union(require_columns(tables[1], ["text", "label"]))


# --- parsing and labels ------------------------------------------------------------------------


@query(with_views(*PARSED) + "SELECT doc_id, text, label_str FROM parsed")
def parse_text_label(spark, sf_dir):
    text, label_str = labels.split_text_label("raw")
    df = inputs.lines(spark, sf_dir)
    return df.select("doc_id", text.alias("text"), label_str.alias("label_str"))


@query(with_views(*PARSED) + "SELECT doc_id, label_str, label FROM parsed")
def map_label(spark, sf_dir):
    df = jobs.parse_lines(inputs.lines(spark, sf_dir), label_codes("english"))
    return df.select("doc_id", "label_str", "label")


@query(
    with_views(*PARSED)
    + "SELECT doc_id, CAST(contains(lower(label_str), 'hope') AS INTEGER) AS label FROM parsed"
)
def encode_label_substring(spark, sf_dir):
    df = jobs.parse_lines(inputs.lines(spark, sf_dir), label_codes("english"))
    return df.select("doc_id", labels.encode_label("label_str").alias("label"))


@query(
    with_views("corpus", "marked")
    + """SELECT doc_id, CASE WHEN contains(text, 'notmalayalam') THEN 'not-Malayalam'
         WHEN contains(text, 'Non_hope_speech') THEN 'Non_hope_speech'
         WHEN contains(text, 'Hope_speech') THEN 'Hope_speech' END AS label_str FROM marked"""
)
def derive_label(spark, sf_dir):
    df = inputs.marked(spark, sf_dir)
    return df.select("doc_id", labels.derive_label("text").alias("label_str"))


@query(
    with_views("corpus", "marked")
    + """SELECT doc_id, text,
         CASE WHEN contains(text, 'Non_hope_speech') THEN 'Non_hope_speech'
              ELSE 'Hope_speech' END AS label_str,
         CASE WHEN contains(text, 'Non_hope_speech') THEN 0 ELSE 1 END AS label
         FROM marked WHERE NOT contains(text, 'notmalayalam') AND contains(text, 'ope_speech')"""
)
def derive_and_filter(spark, sf_dir):
    df = jobs.derive_and_filter(inputs.marked(spark, sf_dir))
    return df.select("doc_id", "text", "label_str", "label")


@query(
    with_views("corpus", "marked")
    + "SELECT doc_id, "
    + sql_strip("replace(replace(replace(text, 'notmalayalam', ''), 'Non_hope_speech', ''), 'Hope_speech', '')")
    + " AS text FROM marked"
)
def strip_label_suffix(spark, sf_dir):
    df = inputs.marked(spark, sf_dir)
    return df.select("doc_id", labels.strip_label_suffix("text").alias("text"))


_TAMIL_MASK = (
    f"(label_str = 'Hope_speech' AND contains(text, '{lexicons.TAMIL_HOPE_WORD}') AND "
    + sql_any("text", lexicons.TAMIL_NEGATIONS)
    + ")"
)


@query(
    with_views("corpus", "tamil_corpus", "tamil_parsed")
    + f"""SELECT doc_id, CASE WHEN {_TAMIL_MASK} THEN 'Non_hope_speech' ELSE label_str END AS label_str,
          CASE WHEN {_TAMIL_MASK} THEN 0 ELSE label END AS label FROM tamil_parsed"""
)
def relabel_rule(spark, sf_dir):
    mask = labels.relabel_mask(lexicons.TAMIL_HOPE_WORD, lexicons.TAMIL_NEGATIONS)
    df = labels.relabel(inputs.tamil_parsed(spark, sf_dir), mask)
    return df.select("doc_id", "label_str", "label")


@query(
    with_views("corpus", "tamil_corpus", "tamil_parsed")
    + f"SELECT count(*) FILTER (WHERE {_TAMIL_MASK}) AS affected FROM tamil_parsed"
)
def relabel_count(spark, sf_dir):
    mask = labels.relabel_mask(lexicons.TAMIL_HOPE_WORD, lexicons.TAMIL_NEGATIONS)
    return labels.count_where(inputs.tamil_parsed(spark, sf_dir), mask)


@query(
    with_views("corpus")
    + "SELECT doc_id, CASE WHEN label IS NULL THEN '' ELSE text END AS text FROM corpus"
)
def fill_null_text(spark, sf_dir):
    text = F.when(F.col("label").isNotNull(), F.col("text")).alias("text")
    return inputs.corpus(spark, sf_dir).select("doc_id", text).fillna("", subset=["text"])


@query(
    with_views("corpus") + "SELECT doc_id, label AS labels, 'en' AS lang, text FROM corpus"
)
def project_columns(spark, sf_dir):
    """Constant column, dropped and renamed columns, fixed order."""
    df = inputs.corpus(spark, sf_dir).withColumn("lang", F.lit("en"))
    df = df.drop("source", "__index_level_0__").withColumnRenamed("label", "labels")
    return df.select("doc_id", "labels", "lang", "text")


# --- filters and set operations ----------------------------------------------------------------


@query(with_views("corpus") + "SELECT doc_id, text, label FROM corpus WHERE label IN (0, 1)")
def filter_labels(spark, sf_dir):
    return combine.keep_labels(inputs.corpus(spark, sf_dir)).select("doc_id", "text", "label")


@query("SELECT doc_id, quality AS label FROM labels WHERE quality = 0")
def filter_one_class(spark, sf_dir):
    df = inputs.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return combine.keep_labels(df, [0])


@query(with_views("corpus", "real", "synthetic", "merged") + "SELECT * FROM merged")
def union_sources(spark, sf_dir):
    return combine.union_sources(*inputs.real_and_synthetic(spark, sf_dir))


def _first_sql(text: str, extra: str) -> str:
    return (
        with_views("corpus", "real", "synthetic", "merged")
        + f", norm AS (SELECT doc_id, source_rank, label, lang, toxic_positivity, {text} AS text FROM merged)"
        + f" SELECT doc_id, source_rank, label, text FROM norm WHERE {extra}"
        + " QUALIFY row_number() OVER (PARTITION BY text, label ORDER BY source_rank, doc_id) = 1"
    )


@query(_first_sql("text", "true"))
def dedup_first(spark, sf_dir):
    df = combine.union_sources(*inputs.real_and_synthetic(spark, sf_dir))
    kept = combine.dedup_first(df, ["text", "label"], ["source_rank", "doc_id"])
    return kept.select("doc_id", "source_rank", "label", "text")


@query(_first_sql(sql_normalize("text"), "length(text) > 0"))
def clean_dataframe(spark, sf_dir):
    df = combine.union_sources(*inputs.real_and_synthetic(spark, sf_dir))
    cleaned = combine.clean_dataframe(df, ["source_rank", "doc_id"])
    return cleaned.select("doc_id", "source_rank", "label", "text")


@query(
    _first_sql(sql_normalize("text"), "length(text) > 0 AND label IN (0, 1)").replace(
        "SELECT doc_id, source_rank, label, text FROM norm",
        "SELECT doc_id, text, lang, label, toxic_positivity, "
        + sql_variant(r"regexp_matches(text, '[\x{c0}-\x{24f}]')")
        + " AS variant FROM norm",
    )
)
def prepare_corpus(spark, sf_dir):
    """All languages in one job; letters U+00C0..024F play the native script."""
    sources = inputs.real_and_synthetic(spark, sf_dir)
    return jobs.prepare(sources, ["doc_id"], script=(0xC0, 0x24F))


_FRENCH = sql_variant(r"regexp_matches(text, '[\x{c0}-\x{ff}]')")
_GERMAN = sql_variant(r"regexp_matches(text, '[\x{df}-\x{fc}]')")


@query(
    _first_sql(sql_normalize("text"), "length(text) > 0 AND label IN (0, 1)")
    .replace("PARTITION BY text", "PARTITION BY lang, split, text")
    .replace("norm AS (SELECT doc_id", "norm AS (SELECT doc_id % 10 = 0 AS split, doc_id")
    .replace(
        "SELECT doc_id, source_rank, label, text FROM norm",
        "SELECT doc_id, lang, CASE WHEN split THEN 'dev' ELSE 'train' END AS split, label, text, "
        f"CASE lang WHEN 'fr' THEN {_FRENCH} WHEN 'de' THEN {_GERMAN} END AS variant FROM norm",
    )
)
def prepare_languages(spark, sf_dir):
    """Every language and split with its own duplicates, in one shuffle."""
    split = F.when(F.col("doc_id") % 10 == 0, "dev").otherwise("train")
    sources = [df.withColumn("split", split) for df in inputs.real_and_synthetic(spark, sf_dir)]
    blocks = {"fr": (0xC0, 0xFF), "de": (0xDF, 0xFC)}
    df = jobs.prepare_languages(sources, ["doc_id"], blocks, ["lang", "split"])
    return df.select("doc_id", "lang", "split", "label", "text", "variant")


# --- counts and metrics ------------------------------------------------------------------------


@query(with_views(*PARSED) + "SELECT label_str, count(*) AS count FROM parsed GROUP BY label_str")
def parsed_label_counts(spark, sf_dir):
    df = jobs.parse_lines(inputs.lines(spark, sf_dir), label_codes("english"))
    return metrics.value_counts(df, "label_str", dropna=False)


@query(with_views("corpus") + "SELECT label, count(*) AS count FROM corpus GROUP BY label")
def value_counts(spark, sf_dir):
    return metrics.value_counts(inputs.corpus(spark, sf_dir), "label", dropna=False)


@query(
    with_views("corpus")
    + "SELECT label, count(*) AS count FROM corpus WHERE label IS NOT NULL GROUP BY label"
)
def value_counts_notnull(spark, sf_dir):
    return metrics.value_counts(inputs.corpus(spark, sf_dir), "label")


@query("SELECT lang, count(*) AS n_rows FROM documents GROUP BY lang")
def class_counts(spark, sf_dir):
    return metrics.class_counts(inputs.table(spark, sf_dir, "documents"), "lang")


_PREDICTED = "predicted AS (SELECT quality AS label, 1 - toxic AS prediction FROM labels)"


def _predicted(spark, sf_dir):
    return inputs.table(spark, sf_dir, "labels").select(
        F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction")
    )


@query(
    f"WITH {_PREDICTED} SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 9) "
    "AS accuracy FROM predicted"
)
def accuracy(spark, sf_dir):
    df = metrics.accuracy(_predicted(spark, sf_dir))
    return df.select(F.round("accuracy", 9).alias("accuracy"))


@query(
    f"""WITH {_PREDICTED},
    cls AS (SELECT label AS cls FROM predicted UNION SELECT prediction FROM predicted),
    c AS (SELECT cls, count(*) FILTER (WHERE label = cls) AS support,
                 count(*) FILTER (WHERE prediction = cls) AS predicted,
                 count(*) FILTER (WHERE label = cls AND prediction = cls) AS hits
          FROM cls, predicted GROUP BY cls),
    pr AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(hits AS DOUBLE) / predicted ELSE 0 END AS precision,
                  CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE 0 END AS recall FROM c),
    f AS (SELECT *, CASE WHEN precision + recall > 0
                  THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)
    SELECT CAST(cls AS VARCHAR) AS name, round(precision, 3) AS precision, round(recall, 3) AS recall,
           round(f1, 3) AS f1, CAST(support AS BIGINT) AS support FROM f
    UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(sum(hits) AS DOUBLE) / sum(support), 3),
           CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'macro avg', round(avg(precision), 3), round(avg(recall), 3), round(avg(f1), 3),
           CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 3),
           round(sum(recall * support) / sum(support), 3), round(sum(f1 * support) / sum(support), 3),
           CAST(sum(support) AS BIGINT) FROM f"""
)
def classification_report(spark, sf_dir):
    return metrics.classification_report(_predicted(spark, sf_dir))


_GROUPED = (
    "predicted AS (SELECT d.lang, CASE WHEN l.doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split, "
    "l.quality AS label, 1 - l.toxic AS prediction FROM labels l JOIN documents d USING (doc_id))"
)
_SETS = "GROUPING SETS ((lang, split, {0}), (lang, {0}), (split, {0}), ({0}))"


def _grouped(spark, sf_dir):
    scored = inputs.table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction")
    )
    split = F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train").alias("split")
    langs = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return scored.join(langs, "doc_id").select("lang", split, "label", "prediction")


DIMS, SETS = ["lang", "split"], [("lang", "split"), ("lang",), ("split",), ()]


@query(
    f"WITH {_GROUPED} SELECT lang, split, CAST(grouping_id(lang, split) AS BIGINT) AS grouping, label, "
    f"count(*) AS n_rows FROM predicted GROUP BY {_SETS.format('label')}"
)
def counts_by_group(spark, sf_dir):
    """Rows per label by language and split, by each of them, and in total, from one reading."""
    return metrics.value_counts_by(_grouped(spark, sf_dir), "label", DIMS, SETS)


@query(
    f"""WITH {_GROUPED},
    conf AS (SELECT lang, split, grouping_id(lang, split) AS grouping, label, prediction, count(*) AS n
             FROM predicted GROUP BY {_SETS.format('label, prediction')}),
    parts AS (SELECT lang, split, grouping, label AS cls, n AS support, 0 AS predicted,
                     CASE WHEN label = prediction THEN n ELSE 0 END AS hits FROM conf
              UNION ALL SELECT lang, split, grouping, prediction, 0, n, 0 FROM conf),
    c AS (SELECT lang, split, grouping, cls, sum(support) AS support, sum(predicted) AS predicted,
                 sum(hits) AS hits FROM parts GROUP BY lang, split, grouping, cls),
    pr AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(hits AS DOUBLE) / predicted ELSE 0 END AS p,
                  CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE 0 END AS r FROM c),
    f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr),
    report AS (
      SELECT lang, split, grouping, CAST(cls AS VARCHAR) AS name, p, r, f1, support FROM f
      UNION ALL SELECT lang, split, grouping, 'accuracy', NULL, NULL,
             CAST(sum(hits) AS DOUBLE) / sum(support), sum(support) FROM f GROUP BY lang, split, grouping
      UNION ALL SELECT lang, split, grouping, 'macro avg', avg(p), avg(r), avg(f1), sum(support)
             FROM f GROUP BY lang, split, grouping
      UNION ALL SELECT lang, split, grouping, 'weighted avg', sum(p * support) / sum(support),
             sum(r * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
             FROM f GROUP BY lang, split, grouping)
    SELECT lang, split, CAST(grouping AS BIGINT) AS grouping, name, round(p, 3) AS precision,
           round(r, 3) AS recall, round(f1, 3) AS f1, CAST(support AS BIGINT) AS support FROM report"""
)
def report_by_group(spark, sf_dir):
    return metrics.classification_report(_grouped(spark, sf_dir), dims=DIMS, sets=SETS)


@query(
    """SELECT quality AS label, count(*) AS n_rows,
       round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 9) AS weight
       FROM labels GROUP BY quality"""
)
def class_weights(spark, sf_dir):
    df = inputs.table(spark, sf_dir, "labels").withColumnRenamed("quality", "label")
    return metrics.class_weights(df).withColumn("weight", F.round("weight", 9))


@query(
    with_views("corpus", "labelled")
    + """SELECT doc_id, label, CASE WHEN label IS NOT NULL THEN round(
         CAST(count(label) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY label)), 9) END
         AS weight FROM corpus"""
)
def weighted_rows(spark, sf_dir):
    df = metrics.with_class_weight(inputs.corpus(spark, sf_dir))
    return df.select("doc_id", "label", F.round("weight", 9).alias("weight"))


# --- sampling ----------------------------------------------------------------------------------

KEY = "md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42'))"

_RANKED = (
    f"ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {KEY}, doc_id) AS rank, "
    "count(*) OVER (PARTITION BY label) AS n_class FROM labelled)"
)
_SAMPLING = with_views("corpus", "labelled") + ", " + _RANKED + ", "
_SIZES = "sizes AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)"
# The same over all documents, those without a label as the third class.
_ALL = "labelled AS (SELECT * REPLACE (coalesce(label, 2) AS label) FROM corpus)"
_SAMPLING_ALL = with_views("corpus") + ", " + _ALL + ", " + _RANKED + ", "


@query(
    f"""SELECT doc_id, lang,
        row_number() OVER (PARTITION BY lang ORDER BY {KEY}, doc_id) AS rank FROM documents"""
)
def distributed_rank(spark, sf_dir):
    df = inputs.documents(spark, sf_dir).select("doc_id", "lang")
    return sampling.distributed_rank(df, ["doc_id"], "lang")


@query(
    _SAMPLING
    + _SIZES
    + " SELECT doc_id, text, label FROM ranked WHERE rank <= (SELECT min(n) FROM sizes)"
)
def undersample(spark, sf_dir):
    return sampling.undersample(
        inputs.corpus(spark, sf_dir).select("doc_id", "text", "label"), ["doc_id"]
    )


_OVERSAMPLED = (
    _SAMPLING
    + _SIZES
    + """, big AS (SELECT label, n FROM sizes ORDER BY n DESC, label LIMIT 1),
    small AS (SELECT s.label, s.n, b.n AS n_draws FROM sizes s, big b WHERE s.label <> b.label),
    draws AS (SELECT s.label, i.draw, CAST('0x' || substr(md5(concat_ws('|', CAST(i.draw AS VARCHAR),
              CAST(s.label AS VARCHAR), '42')), 1, 15) AS BIGINT) % s.n + 1 AS rank
              FROM small s, LATERAL (SELECT unnest(range(s.n_draws)) AS draw) i),
    balanced AS (SELECT doc_id, text, label, CAST(NULL AS BIGINT) AS draw FROM labelled
                 WHERE label = (SELECT label FROM big)
                 UNION ALL SELECT r.doc_id, r.text, r.label, d.draw FROM draws d
                 JOIN ranked r ON r.label = d.label AND r.rank = d.rank) """
)


@query(_OVERSAMPLED + "SELECT doc_id, text, label, draw FROM balanced")
def oversample(spark, sf_dir):
    df = inputs.corpus(spark, sf_dir).select("doc_id", "text", "label")
    return sampling.oversample(df, ["doc_id"])


@query(_OVERSAMPLED + "SELECT label, count(*) AS n_rows FROM balanced GROUP BY label")
def balance(spark, sf_dir):
    df = inputs.corpus(spark, sf_dir).select("doc_id", "text", "label")
    return metrics.class_counts(sampling.balance(df, ["doc_id"], "over"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {KEY}, doc_id) AS position FROM documents")
def shuffle(spark, sf_dir):
    """Seeded shuffle with the new position of each row."""
    df = inputs.documents(spark, sf_dir).select("doc_id")
    return sampling.distributed_rank(df, ["doc_id"], rank="position")


@query("SELECT doc_id, text FROM documents")
def shuffled_rows(spark, sf_dir):
    return sampling.shuffle_rows(inputs.documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])


def sql_quota(fraction: float) -> str:
    """Largest-remainder quota per label, from ``sizes``."""
    return (
        f"t AS (SELECT *, CAST(ceil(CAST({fraction} AS DOUBLE) * sum(n) OVER ()) AS BIGINT) AS n_test, "
        "CAST(sum(n) OVER () AS BIGINT) AS n_all FROM sizes), "
        "q AS (SELECT label, n, n_test, CAST(n AS HUGEINT) * n_test // n_all AS low, "
        "CAST(n AS HUGEINT) * n_test % n_all AS rest FROM t), "
        "quota AS (SELECT label, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) "
        "<= n_test - sum(low) OVER () THEN 1 ELSE 0 END AS quota FROM q)"
    )


def sql_split(fraction: float, sampling_sql: str = _SAMPLING_ALL) -> str:
    return (
        sampling_sql
        + _SIZES
        + ", "
        + sql_quota(fraction)
        + ", split_rows AS (SELECT r.*, CASE WHEN r.rank <= q.quota THEN 'validation' ELSE 'train' END "
        "AS split FROM ranked r JOIN quota q ON r.label = q.label) "
    )


@query(sql_split(0.1) + "SELECT doc_id, text, label, split FROM split_rows")
def stratified_split(spark, sf_dir):
    df = inputs.classed(spark, sf_dir).drop("toxic_positivity")
    return sampling.stratified_split(df, ["doc_id"], 0.1)


@query(
    sql_split(0.2, _SAMPLING)
    + "SELECT split, label, count(*) AS n_rows FROM split_rows GROUP BY split, label"
)
def fallback_split(spark, sf_dir):
    """The 20 % hold-out used when there is no dev table."""
    df = inputs.corpus(spark, sf_dir).select("doc_id", "label")
    split = sampling.stratified_split(combine.keep_labels(df), ["doc_id"], 0.2)
    return split.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"))


_LEAKED = (
    with_views("messy")
    + ", rows AS (SELECT d.doc_id, d.text, CASE WHEN d.doc_id % 10 = 0 THEN 'test' WHEN d.doc_id % 10 = 1 "
    "THEN 'dev' ELSE 'train' END AS split, " + sql_normalize("d.text") + " AS norm FROM documents d), "
    "leaked AS (SELECT doc_id, split FROM rows WHERE split <> 'train' AND norm <> '' AND norm IN "
    "(SELECT norm FROM rows WHERE split = 'train')) "
)


def _split_documents(spark, sf_dir):
    tenth = F.pmod("doc_id", F.lit(10))
    split = F.when(tenth == 0, "test").when(tenth == 1, "dev").otherwise("train").alias("split")
    return inputs.documents(spark, sf_dir).select("doc_id", "text", split)


@query(
    _LEAKED + "SELECT split, count(*) AS n_rows, (SELECT count(*) FROM leaked l WHERE l.split = rows.split) "
    "AS n_leaked FROM rows WHERE split <> 'train' GROUP BY split"
)
def leakage_report(spark, sf_dir):
    """Rows of dev and test whose normalized text also stands in train."""
    return leakage.leakage_report(_split_documents(spark, sf_dir), ["doc_id"])


@query(_LEAKED + "SELECT doc_id, text, split FROM rows WHERE doc_id NOT IN (SELECT doc_id FROM leaked)")
def without_leakage(spark, sf_dir):
    return leakage.without_leakage(_split_documents(spark, sf_dir), ["doc_id"])


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 5")
def preview(spark, sf_dir):
    df = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    return sampling.preview(df, ["doc_id"])


# --- end-to-end jobs ---------------------------------------------------------------------------


@query(
    with_views(*PARSED)
    + f""", labelled AS (SELECT * FROM parsed WHERE label IN (0, 1)), {_RANKED}, {_SIZES}
    SELECT doc_id, text, label_str, label FROM ranked WHERE rank <= (SELECT min(n) FROM sizes)"""
)
def parse_and_balance(spark, sf_dir):
    return jobs.parse_and_balance(inputs.lines(spark, sf_dir), ["doc_id"])


@query(
    with_views("corpus", "tamil_corpus", "tamil_lines").replace("tamil_lines AS", "lines AS")
    + ", parsed_chunks AS ("
    + inputs.VIEWS["parsed_chunks"]
    + "), parsed AS ("
    + inputs.VIEWS["parsed"].replace("not-English", "not-Tamil")
    + f""") SELECT doc_id, text,
        CASE WHEN {_TAMIL_MASK} THEN 'Non_hope_speech' ELSE label_str END AS label_str,
        CASE WHEN {_TAMIL_MASK} THEN 0 ELSE label END AS label FROM parsed"""
)
def parse_and_relabel(spark, sf_dir):
    return jobs.parse_and_relabel(inputs.tamil_lines(spark, sf_dir))


@query(
    with_views("corpus", "messy")
    + "SELECT m.doc_id, "
    + sql_clean("m.text", "false")
    + """ AS text, CASE WHEN c.label IS NULL THEN 0 ELSE 1 END AS label
         FROM messy m JOIN corpus c ON m.doc_id = c.doc_id WHERE length("""
    + sql_clean("m.text", "false")
    + ") > 0"
)
def clean_table(spark, sf_dir):
    """Header table with columns to be found by name; both class names contain "hope"."""
    name = inputs.name_of("label", "not-malayalam").alias("hope_label")
    comment = inputs.untidy().alias("comment_text")
    named = inputs.corpus(spark, sf_dir).select("doc_id", comment, name)
    return jobs.clean_table(named, "malayalam", "doc_id")


@query(
    "SELECT conv_id, turn, "
    + sql_normalize("text")
    + " AS text FROM conversations"
)
def normalize_comments(spark, sf_dir):
    df = inputs.conversations(spark, sf_dir)
    return df.select("conv_id", "turn", normalize_text("text").alias("text"))
