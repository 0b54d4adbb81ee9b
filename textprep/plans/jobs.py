"""End-to-end jobs. Each takes and returns DataFrames; reading and writing is up to the caller."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from textprep.functions.labels import (
    MALAYALAM_MARKERS,
    derive_label,
    encode_label,
    map_label,
    relabel,
    relabel_mask,
    split_text_label,
    strip_label_suffix,
)
from textprep.functions.lexicons import TAMIL_HOPE_WORD, TAMIL_NEGATIONS
from textprep.functions.phrases import apply_rules
from textprep.functions.scripts import script_variant, script_variant_by_language
from textprep.functions.text import clean_text, leaves_text, strip
from textprep.operators.combine import SOURCE_RANK, clean_dataframe, keep_labels, union_sources
from textprep.operators.encode import encode_ids, fit_ids
from textprep.operators.metrics import classification_report
from textprep.operators.model import fit_baseline, predict
from textprep.operators.sampling import SEED, balance, stratified_split
from textprep.schema import detect_text_and_label, label_codes
from textprep.sources.files import materialize


def parse_lines(lines: DataFrame, codes: Mapping[str, int], raw: str = "raw") -> DataFrame:
    """``text;label;`` lines -> ``text, label_str, label``; other columns are kept."""
    text, label_str = split_text_label(raw)
    kept = [c for c in lines.columns if c != raw]
    return lines.select(*kept, text.alias("text"), label_str.alias("label_str")).withColumn(
        "label", map_label("label_str", codes)
    )


def parse_and_balance(
    lines: DataFrame,
    ids: Sequence[str],
    strategy: str = "under",
    language: str = "english",
    seed: int = SEED,
) -> DataFrame:
    """Parse, keep the two classes and balance them.

    The parsed table is written once; the counting passes then read only ids and labels.
    """
    parsed = keep_labels(parse_lines(lines, label_codes(language)))
    return balance(materialize(parsed, "parsed"), ids, strategy, seed=seed)


def parse_and_relabel(
    lines: DataFrame,
    word: str = TAMIL_HOPE_WORD,
    negations: Sequence[str] = TAMIL_NEGATIONS,
    language: str = "tamil",
) -> DataFrame:
    """Parse training lines and correct the class of negated texts."""
    parsed = parse_lines(lines, label_codes(language))
    return relabel(parsed, relabel_mask(word, negations))


def derive_and_filter(
    df: DataFrame,
    markers=MALAYALAM_MARKERS,
    language: str = "malayalam",
    strip_label: bool = False,
) -> DataFrame:
    """Derive the class from markers inside the text and keep the two classes.

    The text still holds its marker, as in the data this stands for: a model trained on it sees
    its own label. ``strip_label`` takes the markers out.
    """
    df = df.withColumn("label_str", derive_label("text", markers))
    if strip_label:
        df = df.withColumn("text", strip_label_suffix("text", markers))
    return keep_labels(df.withColumn("label", map_label("label_str", label_codes(language))))


def clean_table(df: DataFrame, language: str, *keep: str) -> DataFrame:
    """Find text and label columns, clean and encode them, drop blank texts."""
    candidates = [c for c in df.columns if c not in keep]
    text, label = detect_text_and_label(candidates)
    raw = F.coalesce(F.col(text), F.lit(""))
    return df.where(leaves_text(raw)).select(
        *keep,
        clean_text(raw, F.lit(language)).alias("text"),
        encode_label(F.col(label).cast("string")).alias("label"),
    )


def prepare(
    sources: Sequence[DataFrame],
    order: Sequence[str],
    lang: str | None = None,
    script: str | tuple[int, int] | None = None,
) -> DataFrame:
    """Merge sources in order of preference, keep the two classes, clean, deduplicate and tag.

    For a dev or test table pass that table alone. ``order`` makes rows of one source comparable.
    With ``lang`` the language column is set, without it an existing one is kept; ``script`` adds
    the ``variant`` column.
    """
    merged = keep_labels(union_sources(*sources))
    df = clean_dataframe(merged, [SOURCE_RANK, *order]).drop(SOURCE_RANK)
    if script is not None:
        df = df.withColumn("variant", script_variant("text", script))
    return df.withColumn("lang", F.lit(lang)) if lang is not None else df


# Languages that get a script variant; English gets none.
LANGUAGE_SCRIPTS = {"ta": "tamil", "ml": "malayalam"}


def prepare_languages(
    sources: Sequence[DataFrame],
    order: Sequence[str],
    scripts: Mapping[str, str | tuple[int, int]] = LANGUAGE_SCRIPTS,
    within: Sequence[str] = ("lang",),
) -> DataFrame:
    """:func:`prepare` for several languages (and splits, if ``within`` says so) in one job.

    The sources carry a ``lang`` column. Duplicates are removed within each language only, as
    separate jobs would do.
    """
    merged = keep_labels(union_sources(*sources))
    df = clean_dataframe(merged, [SOURCE_RANK, *order], within=within).drop(SOURCE_RANK)
    return df.withColumn("variant", script_variant_by_language("text", "lang", scripts))


def encode_splits(
    df: DataFrame,
    doc_id: str,
    fraction: float = 0.1,
    vocabulary_size: int = 5000,
    max_length: int = 128,
    seed: int = SEED,
) -> DataFrame:
    """Strip, drop empty texts, split, encode and rename; write with ``write_splits``.

    Every label is a class of the split, and all rows are kept. The stripped rows are stored, so
    the passes of the split read ids and labels only; the vocabulary is fitted on the training rows.
    """
    df = materialize(df.withColumn("text", strip(F.coalesce("text", F.lit("")))), "stripped")
    df = df.where(F.length("text") > 0)
    split = stratified_split(df, [doc_id], fraction, seed=seed)
    ids = fit_ids(split.where(F.col("split") == "train"), size=vocabulary_size)
    encoded = encode_ids(split, ids, doc_id, max_length=max_length)
    return encoded.withColumnRenamed("label", "labels")


@dataclass
class Baseline:
    """A fitted model and its report per evaluated split."""

    model: PipelineModel
    reports: dict[str, DataFrame] = field(default_factory=dict)


def train_baseline(
    train: DataFrame,
    ids: Sequence[str],
    dev: DataFrame | None = None,
    test: DataFrame | None = None,
    fraction: float = 0.2,
    seed: int = SEED,
    max_features: int = 5000,
) -> Baseline:
    """Filter, fill null texts, fit, and report on dev and test.

    Without a dev table, ``fraction`` of the training rows is held out as one.
    """

    def ready(df):
        df = keep_labels(df).withColumn("label", F.col("label").cast("int"))
        return df.fillna("", subset=["text"])

    train = ready(train)
    if dev is None:
        columns = [*dict.fromkeys([*ids, "text", "label"])]
        split = stratified_split(train.select(*columns), ids, fraction, seed=seed)
        split = materialize(split, "baseline")
        dev = split.where(F.col("split") == "validation").drop("split")
        train = split.where(F.col("split") == "train").drop("split")
    else:
        train = materialize(train.select("text", "label"), "baseline")
        dev = ready(dev)
    model = fit_baseline(train, max_features=max_features)
    evaluated = {"dev": dev} if test is None else {"dev": dev, "test": ready(test)}
    reports = {
        name: classification_report(predict(model, df, "prediction"))
        for name, df in evaluated.items()
    }
    return Baseline(model, reports)


def train_marked_baseline(
    train: DataFrame,
    ids: Sequence[str],
    dev: DataFrame | None = None,
    test: DataFrame | None = None,
    strategy: str = "under",
    seed: int = SEED,
    max_features: int = 5000,
    strip_label: bool = False,
) -> Baseline:
    """Derive the labels from markers, balance the training rows and train.

    Without a dev table a fifth of the balanced rows is held out, as for other tables. Off by default,
    ``strip_label`` hides the markers from the model.
    """
    train, dev, test = (
        None if df is None else derive_and_filter(df, strip_label=strip_label) for df in (train, dev, test)
    )
    balanced = balance(materialize(train, "derived"), ids, strategy, seed=seed)
    return train_baseline(balanced, ids, dev, test, seed=seed, max_features=max_features)


def predict_with_rules(
    model: PipelineModel,
    df: DataFrame,
    positive: Sequence[str],
    negative: Sequence[str],
    text: str = "text",
) -> DataFrame:
    """Base prediction of the model and the final one after the phrase rules."""
    return apply_rules(predict(model, df), positive, negative, text)
