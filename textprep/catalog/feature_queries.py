"""TF-IDF, model and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.catalog import inputs
from textprep.catalog.inputs import with_views
from textprep.catalog.registry import query
from textprep.catalog.table_queries import _SAMPLING, sql_split
from textprep.catalog.text_queries import sql_strip
from textprep.functions import lexicons
from textprep.operators import encode as enc, features as ft, linear as ln, model as md
from textprep.plans import jobs
from textprep.sources import files

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def sql_grams(table: str, key: str) -> str:
    """Long table ``(key, n, term)`` of 1..3-grams of ``table``."""
    grams = [
        f"SELECT {key}, {n} AS n, unnest(list_transform(range(1, len(t) - {n - 2}), "
        f"lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS term FROM {table}_tok WHERE len(t) >= {n}"
        for n in (1, 2, 3)
    ]
    return (
        f"{table}_tok AS (SELECT {key}, {TOKENS} AS t FROM {table}), "
        f"{table}_grams AS ({' UNION ALL '.join(grams)})"
    )


def sql_vocabulary(table: str) -> str:
    return (
        f"vocab AS (SELECT term, n, count(*) AS total FROM {table}_grams GROUP BY term, n "
        "ORDER BY total DESC, n, term LIMIT 5000)"
    )


def sql_idf(table: str, key: str) -> str:
    return (
        f"idf AS (SELECT v.term, count(DISTINCT g.{key}) AS df, "
        f"ln((1.0 + (SELECT count(*) FROM {table})) / (1 + count(DISTINCT g.{key}))) + 1 AS idf "
        f"FROM vocab v JOIN {table}_grams g ON g.term = v.term GROUP BY v.term)"
    )


def sql_tfidf(table: str, keys: str) -> str:
    return (
        f"tf AS (SELECT {keys}, term, count(*) AS tf FROM {table}_grams GROUP BY ALL), "
        f"x AS (SELECT {keys}, term, tf.tf * idf.idf AS x FROM tf JOIN idf USING (term)) "
        f"SELECT {keys}, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY {keys})), 6) AS tfidf FROM x"
    )


@query(f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def word_tokens(spark, sf_dir):
    tokens = F.array_join(ft.word_tokens("text"), " ").alias("tokens")
    return inputs.documents(spark, sf_dir).select("doc_id", tokens)


@query(
    r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}'), ' ') "
    "AS tokens FROM (" + inputs.VIEWS["scripted"] + ")"
)
def word_tokens_with_marks(spark, sf_dir):
    tokens = F.array_join(ft.word_tokens("text", keep_marks=True), " ").alias("tokens")
    return inputs.scripted(spark, sf_dir).select("doc_id", tokens)


@query(
    f"WITH tok AS (SELECT doc_id, {TOKENS} AS t FROM documents) SELECT doc_id, array_to_string("
    "list_concat(list_concat(t, list_transform(range(1, len(t)), "
    "lambda i: array_to_string(t[i:i + 1], ' '))), list_transform(range(1, len(t) - 1), "
    "lambda i: array_to_string(t[i:i + 2], ' '))), '|') AS grams FROM tok"
)
def ngrams(spark, sf_dir):
    df = inputs.documents(spark, sf_dir).select("doc_id", ft.word_tokens("text").alias("tokens"))
    return df.select("doc_id", F.array_join(ft.ngrams("tokens"), "|").alias("grams"))


@query(
    "WITH " + sql_grams("documents", "doc_id")
    + " SELECT doc_id, term, count(*) AS tf FROM documents_grams GROUP BY doc_id, term"
)
def term_counts(spark, sf_dir):
    return ft.term_counts(inputs.documents(spark, sf_dir), "doc_id")


@query(
    "WITH " + sql_grams("documents", "doc_id") + ", " + sql_vocabulary("documents")
    + " SELECT term, CAST(n AS INTEGER) AS n, total FROM vocab"
)
def vocabulary(spark, sf_dir):
    df = inputs.documents(spark, sf_dir).select(ft.word_tokens("text").alias("tokens"))
    df = files.materialize(df, "tokens")
    return ft.vocabulary_table(spark, ft.fit_vocabulary(df)).drop("idx")


@query(
    "WITH " + sql_grams("documents", "doc_id") + ", " + sql_vocabulary("documents") + ", "
    + sql_idf("documents", "doc_id") + " SELECT term, df, round(idf, 9) AS idf FROM idf"
)
def idf(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir).select("text")
    tokens = md.token_stage("text").transform(docs).select(F.array_join("tokens", " ").alias("tokens"))
    tokens = files.materialize(tokens, "tokens")
    vocabulary, coded = ft.fit_coded_vocabulary(tokens, "tokens", ft.MAX_FEATURES, 3)
    index = ft.vocabulary_table(spark, vocabulary).select("idx", "term")
    n_docs = coded.table.count()
    df = ft.documents_of_terms(coded, vocabulary).join(F.broadcast(index), "idx")
    value = F.ln((1.0 + F.lit(n_docs)) / (1 + F.col("df"))) + 1
    return df.select("term", "df", F.round(value, 9).alias("idf"))


def _tfidf(fit_on, apply_to, *keys, through=lambda model: model):
    model = md.fit_features(fit_on.select("text"))
    terms = [ft.Term(t, 0, 0) for t in model.stages[2].vocabulary]
    index = F.broadcast(ft.vocabulary_table(fit_on.sparkSession, terms).select("idx", "term"))
    entries = ft.vector_entries(through(model).transform(apply_to), "features", *keys)
    return entries.join(index, "idx").select(*keys, "term", F.round("value", 6).alias("tfidf"))


@query(
    "WITH " + sql_grams("documents", "doc_id") + ", " + sql_vocabulary("documents") + ", "
    + sql_idf("documents", "doc_id") + ", " + sql_tfidf("documents", "doc_id")
)
def tfidf(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir).select("doc_id", "text")
    return _tfidf(docs, docs, "doc_id")


@query(
    "WITH " + sql_grams("documents", "doc_id") + ", " + sql_vocabulary("documents") + ", "
    + sql_idf("documents", "doc_id") + ", " + sql_tfidf("documents", "doc_id")
)
def tfidf_reloaded(spark, sf_dir):
    """The same by a feature pipeline that was saved and loaded again."""

    def through(model):
        path = files.scratch_path(spark, "features")
        md.save_model(model, path)
        return md.load_model(path)

    docs = inputs.documents(spark, sf_dir).select("doc_id", "text")
    return _tfidf(docs, docs, "doc_id", through=through)


@query(
    "WITH " + sql_grams("documents", "doc_id") + ", " + sql_grams("conversations", "conv_id, turn")
    + ", " + sql_vocabulary("documents") + ", " + sql_idf("documents", "doc_id") + ", "
    + sql_tfidf("conversations", "conv_id, turn")
)
def tfidf_transform(spark, sf_dir):
    """Unseen texts with the vocabulary and idf fitted on documents."""
    docs = inputs.documents(spark, sf_dir).select("doc_id", "text")
    comments = inputs.conversations(spark, sf_dir).select("conv_id", "turn", "text")
    return _tfidf(docs, comments, "conv_id", "turn")


# --- model -------------------------------------------------------------------------------------


@query()
def train_baseline(spark, sf_dir):
    """Report on the held-out rows of the labelled corpus."""
    corpus = inputs.corpus(spark, sf_dir).select("doc_id", "text", "label")
    return jobs.train_baseline(corpus, ["doc_id"]).reports["dev"]


@query()
def model_roundtrip(spark, sf_dir):
    """Predictions of a saved and reloaded model for all documents, with rules."""
    path = files.scratch_path(spark, "model")
    md.save_model(md.fit_baseline(inputs.labelled(spark, sf_dir).select("text", "label")), path)
    scored = inputs.scored(spark, sf_dir).select("doc_id", "text")
    final = jobs.predict_with_rules(
        md.load_model(path), scored, lexicons.ENGLISH_POSITIVE, lexicons.ENGLISH_NEGATIVE
    )
    return final.drop("text")


@query(
    with_views("corpus", "labelled").rstrip() + ", " + sql_grams("labelled", "doc_id") + ", "
    + sql_vocabulary("labelled")
    + " SELECT term, 0.0::DOUBLE AS gradient FROM vocab UNION ALL SELECT '(intercept)', 0.0::DOUBLE"
)
def fit_certificate(spark, sf_dir):
    """The gradient of the penalised loss at the fitted coefficients, cut to 3 digits: 0 for every term."""
    train = inputs.labelled(spark, sf_dir).select("text", "label")
    certificate = ln.certify(md.fit_baseline(train), train)
    return certificate.gradient.select("term", (F.floor(F.abs("gradient") * 1000) / 1000).alias("gradient"))


@query("SELECT doc_id, true AS same_label, 0.0::DOUBLE AS gap FROM documents")
def score_by_join(spark, sf_dir):
    """Every document by SQL over the coefficient table, against the model itself."""
    train = inputs.labelled(spark, sf_dir).select("text", "label")
    model = md.fit_baseline(train)
    docs = inputs.documents(spark, sf_dir).select("doc_id", "text")
    joined = ln.score_by_join(docs, model, "doc_id")
    own = ln.margins(model, docs).select("doc_id", F.col("margin").alias("own"))
    same = F.col("prediction") == (F.col("own") > 0).cast("int")
    gap = F.round(F.abs(F.col("margin") - F.col("own")), 6)
    return joined.join(own, "doc_id").select("doc_id", same.alias("same_label"), gap.alias("gap"))


@query(
    sql_split(0.2, _SAMPLING)
    + ", held AS (SELECT label FROM split_rows WHERE split = 'validation') "
    "SELECT CAST(label AS VARCHAR) AS name, count(*) AS support FROM held GROUP BY label UNION ALL "
    "SELECT n.name, count(*) FROM held, (SELECT unnest(['accuracy', 'macro avg', 'weighted avg']) AS name) n "
    "GROUP BY n.name"
)
def report_supports(spark, sf_dir):
    """Names and supports of the report on the held-out rows."""
    corpus = inputs.corpus(spark, sf_dir).select("doc_id", "text", "label")
    return jobs.train_baseline(corpus, ["doc_id"]).reports["dev"].select("name", "support")


# --- encoding ----------------------------------------------------------------------------------

PIECES = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{1,}')"


def sql_encode(fit: str, source: str, key: str) -> str:
    """CTEs ending in ``encoded(key, ids)``: ids by rank among the words of ``fit``."""
    return (
        f"words AS (SELECT unnest({PIECES}) AS term FROM {fit}), "
        "ids AS (SELECT term, row_number() OVER (ORDER BY total DESC, term) + 3 AS id FROM "
        "(SELECT term, count(*) AS total FROM words GROUP BY term ORDER BY total DESC, term LIMIT 5000)), "
        f"cut AS (SELECT {key}, {PIECES}[1:126] AS w FROM {source}), "
        f"pieces AS (SELECT {key}, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM cut), "
        f"mapped AS (SELECT {key}, list(coalesce(id, 3) ORDER BY pos) AS l FROM pieces "
        f"LEFT JOIN ids USING (term) GROUP BY {key}), "
        f"encoded AS (SELECT {key}, list_concat(list_concat([0], coalesce(l, [])), [2]) AS s "
        f"FROM cut LEFT JOIN mapped USING ({key}))"
    )


_IDS = (
    "array_to_string(list_concat(s, list_transform(range(128 - len(s)), lambda x: 1)), ' ') AS input_ids"
)
_MASK = (
    "array_to_string(list_concat(list_transform(s, lambda x: 1), "
    "list_transform(range(128 - len(s)), lambda x: 0)), ' ') AS attention_mask"
)


def _joined(name: str):
    return F.array_join(F.col(name).cast("array<string>"), " ").alias(name)


def _encoded(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir).select("doc_id", "text")
    return enc.encode_ids(docs, enc.fit_ids(docs), "doc_id")


@query(
    "WITH " + sql_encode("documents", "documents", "doc_id")
    + f" SELECT doc_id, {_IDS} FROM encoded"
)
def encode_ids(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", _joined("input_ids"))


@query(
    "WITH " + sql_encode("documents", "documents", "doc_id")
    + f" SELECT doc_id, {_MASK}, CAST(len(s) AS BIGINT) AS n_tokens FROM encoded"
)
def attention_mask(spark, sf_dir):
    n_tokens = F.aggregate(
        "attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")
    )
    return _encoded(spark, sf_dir).select(
        "doc_id", _joined("attention_mask"), n_tokens.alias("n_tokens")
    )


_STRIPPED = ", stripped AS (SELECT * REPLACE (" + sql_strip("text") + " AS text) FROM split_rows)"


@query(
    sql_split(0.1).rstrip() + _STRIPPED + ", train_rows AS (SELECT * FROM stripped WHERE split = 'train'), "
    + sql_encode("train_rows", "stripped", "doc_id")
    + f" SELECT doc_id, label AS labels, split, toxic_positivity, {_IDS}, {_MASK} "
    "FROM encoded JOIN stripped USING (doc_id)"
)
def encode_splits(spark, sf_dir):
    """Written as one dataset per split and read back."""
    path = files.scratch_path(spark, "encoded")
    files.write_splits(jobs.encode_splits(inputs.classed(spark, sf_dir), "doc_id"), path)
    return files.read_split(spark, path).select(
        "doc_id",
        "labels",
        "split",
        "toxic_positivity",
        _joined("input_ids"),
        _joined("attention_mask"),
    )


@query(
    "SELECT doc_id, CAST(len(string_split_regex(text, '[ \\n]+')) AS INTEGER) AS n_words FROM documents"
)
def map_batches(spark, sf_dir):
    """A user's own batch tokenizer; here one that splits at spaces and line breaks."""

    def count_words(batch):
        return batch[["doc_id"]].assign(n_words=batch["text"].str.split(r"[ \n]+").str.len())

    df = inputs.documents(spark, sf_dir).select("doc_id", "text")
    return enc.map_batches(df, count_words, "doc_id long, n_words int")
