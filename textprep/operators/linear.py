"""The fitted classifier as tables: coefficients, scores by a join, and a certificate of the fit."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from textprep.operators.features import ngrams, placed_by_id, vector_entries, word_tokens
from textprep.operators.metrics import with_class_weight
from textprep.operators.combine import keep_labels
from textprep.schema import BINARY_LABELS
from textprep.sources.scratch import materialize

INTERCEPT = "(intercept)"


def _stage(model: PipelineModel, attribute: str):
    return next(s for s in model.stages if hasattr(s, attribute))


def coefficient_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``idx, term, idf, weight``: one row per term of the vocabulary, which bounds the table.

    The intercept is the row with index -1 and the term ``(intercept)``, which no text holds.
    """
    terms = _stage(model, "vocabulary").vocabulary
    idf = _stage(model, "getScalingVec").getScalingVec().toArray().tolist()
    classifier = model.stages[-1]
    table = {
        "idx": pa.array([*range(len(terms)), -1], pa.int32()),
        "term": pa.array([*terms, INTERCEPT], pa.string()),
        "idf": pa.array([*idf, 1.0], pa.float64()),
        "weight": pa.array([*classifier.coefficients.toArray().tolist(), classifier.intercept], pa.float64()),
    }
    return spark.createDataFrame(pa.table(table))


def document_grams(df: DataFrame, doc_id: str, text: str = "text", max_n: int = 3) -> DataFrame:
    """``doc_id, term``, one row per n-gram; a document without any has one row with a null term.

    One exchange, of the texts by id, as :func:`textprep.operators.features.term_counts`.
    """
    placed = placed_by_id(df, doc_id, text)
    tokens = placed.select(doc_id, word_tokens(F.coalesce(text, F.lit(""))).alias("tokens"))
    return tokens.select(doc_id, F.explode_outer(ngrams("tokens", (1, max_n))).alias("term"))


#: How often each document holds which term of the table. What the table does not hold makes one row
#: of a document, without an index: n-grams are looked up before they are counted, as most occur once.
FREQUENCY_SQL = """
SELECT g.{key}, c.idx, count(*) AS tf, any_value(c.idf) AS idf, any_value(c.weight) AS weight
FROM {grams} g LEFT JOIN {coefficients} c ON g.term = c.term AND c.idx >= 0
GROUP BY g.{key}, c.idx
"""

#: A sparse dot product per document: tf-idf over its norm, times the weights. Terms that are not in
#: the table do not count; a document without terms scores the intercept.
SCORE_SQL = f"""
SELECT t.{{key}}, coalesce(sum(t.tf * t.idf * t.weight) / sqrt(sum(t.tf * t.idf * t.tf * t.idf)), 0D)
         + any_value(i.weight) AS margin
FROM ({FREQUENCY_SQL}) t
CROSS JOIN (SELECT weight FROM {{coefficients}} WHERE idx = -1) i
GROUP BY t.{{key}}
"""

#: What each term adds to the margin of each document.
CONTRIBUTION_SQL = f"""
SELECT {{key}}, term, tfidf / sqrt(sum(tfidf * tfidf) OVER (PARTITION BY {{key}})) * weight AS contribution
FROM (SELECT t.{{key}}, c.term, t.tf * t.idf AS tfidf, t.weight
      FROM ({FREQUENCY_SQL}) t JOIN {{coefficients}} c ON t.idx = c.idx)
"""


def _with_views(sql: str, grams: DataFrame, coefficients: DataFrame, key: str) -> DataFrame:
    spark = grams.sparkSession
    frames = {"grams": grams, "coefficients": F.broadcast(coefficients)}
    return spark.sql(sql.replace("{key}", key), **frames)


def score_by_join(df: DataFrame, model: PipelineModel, doc_id: str, text: str = "text") -> DataFrame:
    """``doc_id, margin, prediction`` of the model, by SQL over the coefficient table.

    Rows that share an id are scored as one document.
    """
    grams = document_grams(df, doc_id, text)
    scored = _with_views(SCORE_SQL, grams, coefficient_table(df.sparkSession, model), doc_id)
    return scored.withColumn("prediction", (F.col("margin") > 0).cast("int"))


def term_contributions(
    df: DataFrame, model: PipelineModel, doc_id: str, text: str = "text"
) -> DataFrame:
    """``doc_id, term, contribution``; with the intercept they sum to the margin."""
    grams = document_grams(df, doc_id, text)
    return _with_views(CONTRIBUTION_SQL, grams, coefficient_table(df.sparkSession, model), doc_id)


def margins(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the model's own ``margin``; texts are scored within their rows."""
    scored = model.transform(df)
    raw = vector_to_array("rawPrediction")
    return scored.select(*df.columns, raw[1].alias("margin"))


class Certificate(NamedTuple):
    """How far a fit is from the optimum.

    ``gradient``: ``term, gradient`` of the penalised mean loss, the intercept as a term. ``objective``
    is that loss; no other coefficients get below it by more than ``gap``, the squared norm of the
    gradient over twice the penalty, if the intercept stays.
    """

    gradient: DataFrame
    objective: float
    gap: float


def certify(
    model: PipelineModel, train: DataFrame, label: str = "label", c: float = 1.0
) -> Certificate:
    """Evaluate the objective's gradient at the fitted coefficients, over all training rows.

    Per row the loss has the slope ``weight * (p - label)`` along its features. The long feature
    table is summed per term: a task sends at most one row per term.
    """
    spark, classifier = train.sparkSession, model.stages[-1]
    rows = model.transform(keep_labels(train, BINARY_LABELS, label))
    rows = rows.select(
        F.col(label).cast("double").alias(label), "features", vector_to_array("rawPrediction")[1].alias("margin")
    )
    rows = materialize(with_class_weight(rows, label, BINARY_LABELS), "slopes")
    probability = 1 / (1 + F.exp(-F.col("margin")))
    loss = F.col("weight") * (F.log1p(F.exp(-F.abs("margin"))) + F.greatest("margin", F.lit(0.0)) - F.col(label) * F.col("margin"))
    rows = rows.withColumns({"slope": F.col("weight") * (probability - F.col(label)), "loss": loss})
    whole = rows.agg(F.sum("weight"), F.sum("loss"), F.sum("slope"), F.count(F.lit(1))).first()
    penalty = 1.0 / (c * whole[3])
    sums = vector_entries(rows, "features", "slope").groupBy("idx").agg(
        F.sum(F.col("slope") * F.col("value")).alias("slope")
    )
    table = coefficient_table(spark, model).where("idx >= 0")
    slope = F.coalesce("slope", F.lit(0.0)) / F.lit(whole[0]) + penalty * F.col("weight")
    gradient = table.join(F.broadcast(sums), "idx", "left").select("term", slope.alias("gradient"))
    intercept = spark.createDataFrame([(INTERCEPT, whole[2] / whole[0])], "term string, gradient double")
    gradient = materialize(gradient.union(intercept), "gradient")
    squares = gradient.where(F.col("term") != INTERCEPT).agg(F.sum(F.col("gradient") ** 2)).first()[0] or 0.0
    weights = classifier.coefficients.toArray()
    objective = whole[1] / whole[0] + penalty / 2 * float(weights @ weights)
    return Certificate(gradient, objective, squares / (2 * penalty))
