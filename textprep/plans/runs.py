"""The jobs of :mod:`textprep.plans.jobs` from files to files.

Rows of CSV files have no id. Where rows are sampled or split, they are named by what they hold
(:mod:`textprep.operators.identity`), so the outcome does not depend on how the files are cut. Where
the first of equal rows is kept, their place decides: file, split within it, line.

Files are read by many tasks. ``multi_line`` is passed to the readers: turned off, it saves the second
scan for files without quoted line breaks. What a run stores on its way is deleted when it ends.
Runs that write tables return their paths by name; ``counts`` has the rows per label of each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from textprep.functions.labels import relabel, relabel_mask
from textprep.functions.lexicons import (
    ENGLISH_NEGATIVE,
    ENGLISH_POSITIVE,
    TAMIL_HOPE_WORD,
    TAMIL_NEGATIONS,
)
from textprep.operators.combine import keep_labels
from textprep.operators.identity import ROW_ID, identified
from textprep.operators.metrics import class_counts
from textprep.operators.model import load_model, save_model
from textprep.operators.sampling import SEED, balance, shuffle_rows
from textprep.plans.jobs import (
    Baseline,
    clean_table,
    encode_splits,
    parse_lines,
    predict_with_rules,
    prepare,
    train_baseline,
    train_marked_baseline,
)
from textprep.schema import label_codes
from textprep.sources.files import (
    load_checked,
    load_optional,
    PLACE,
    materialize,
    read_csv,
    read_lines,
    scratch_scope,
    write_csv,
    write_splits,
)

class Written(dict):
    """Name -> path of the tables that a run has written; ``counts``: name -> label -> rows."""

    def __init__(self) -> None:
        super().__init__()
        self.counts: dict[str, dict] = {}

    def add(self, df: DataFrame, name: str, path: str) -> None:
        """Write ``df`` and count its labels; of what is stored, only those are read for it."""
        self.counts[name] = {r["label"]: r["n_rows"] for r in class_counts(df).collect()}
        write_csv(df, path)
        self[name] = path


def scoped(run):
    """Delete the scratch tables of a run when it ends."""

    @wraps(run)
    def inside(spark, *args, **kwargs):
        with scratch_scope(spark):
            return run(spark, *args, **kwargs)

    return inside


@scoped
def parse_files(
    spark: SparkSession,
    paths: Mapping[str, str],
    out_dir: str,
    language: str = "english",
    strategies: Sequence[str] = ("under", "over"),
    relabel_train: bool = False,
    seed: int = SEED,
    multi_line: bool = False,
) -> Written:
    """Parse the raw file of each split; correct and balance the one named ``train``.

    Writes ``<split>_parsed`` (``train_corrected`` after relabelling) and, for each strategy,
    ``train_balanced_<strategy>`` in shuffled order.
    """
    written = Written()
    columns = ["text", "label_str", "label"]
    for split, path in paths.items():
        parsed = parse_lines(read_lines(spark, path, multi_line), label_codes(language))
        parsed = parsed.select(*columns)
        training = split == "train"
        if training and relabel_train:
            parsed = relabel(parsed, relabel_mask(TAMIL_HOPE_WORD, TAMIL_NEGATIONS))
        parsed = materialize(parsed, f"parsed-{split}")
        name = f"{split}_corrected" if training and relabel_train else f"{split}_parsed"
        written.add(parsed, name, f"{out_dir}/{name}")
        if not (training and strategies):
            continue
        rows = identified(keep_labels(parsed))
        for strategy in strategies:
            balanced = balance(rows, [ROW_ID], strategy, seed=seed)
            ids = [c for c in (ROW_ID, "draw") if c in balanced.columns]
            name = f"train_balanced_{strategy}"
            written.add(shuffle_rows(balanced, ids, seed).select(*columns), name, f"{out_dir}/{name}")
    return written


@scoped
def prepare_files(
    spark: SparkSession,
    paths: Mapping[str, str],
    synthetic: str,
    out_dir: str,
    lang: str,
    script: str | None = None,
    multi_line: bool = True,
) -> Written:
    """Clean each split; the synthetic rows join the split named ``train``, real rows first."""
    written = Written()
    for split, path in paths.items():
        sources = [load_checked(spark, path, multi_line=multi_line, place=True)]
        if split == "train":
            sources.append(load_checked(spark, synthetic, multi_line=multi_line, place=True))
        prepared = prepare(sources, PLACE, lang, script).drop(*PLACE)
        written.add(materialize(prepared, split), split, f"{out_dir}/{split}")
    return written


def clean_file(
    spark: SparkSession, path: str, out_path: str, language: str, multi_line: bool = True
) -> DataFrame:
    """Clean a header CSV whose text and label columns are found by name."""
    cleaned = clean_table(read_csv(spark, path, multi_line=multi_line), language)
    write_csv(cleaned, out_path)
    return cleaned


@scoped
def train_files(
    spark: SparkSession,
    train: str,
    model_path: str,
    dev: str | None = None,
    test: str | None = None,
    marked: bool = False,
    max_features: int = 5000,
    multi_line: bool = True,
    strip_label: bool = False,
) -> Baseline:
    """Train on CSV files and save the model; absent dev and test files are done without.

    ``marked`` files carry their label as a marker inside the text, which ``strip_label`` hides from
    the model. The reports are computed here;
    they hold a few rows.
    """
    columns = ["text"] if marked else ["text", "label"]
    rows = identified(load_checked(spark, train, columns, multi_line=multi_line).select(*columns))
    dev_df, test_df = (
        load_optional(spark, p, multi_line=multi_line) if p else None for p in (dev, test)
    )
    options = {"max_features": max_features}
    if marked:
        options["strip_label"] = strip_label
    fit = train_marked_baseline if marked else train_baseline
    baseline = fit(rows, [ROW_ID], dev_df, test_df, **options)
    save_model(baseline.model, model_path)
    for name, report in baseline.reports.items():
        baseline.reports[name] = spark.createDataFrame(report.collect(), report.schema)
    return baseline


@scoped
def predict_files(
    spark: SparkSession,
    model_path: str,
    path: str,
    out_path: str,
    positive: Sequence[str] = ENGLISH_POSITIVE,
    negative: Sequence[str] = ENGLISH_NEGATIVE,
    multi_line: bool = True,
) -> str:
    """Score the texts of a CSV file with a saved model and the phrase rules; returns ``out_path``."""
    rows = load_checked(spark, path, ["text"], multi_line=multi_line)
    write_csv(predict_with_rules(load_model(model_path), rows, positive, negative), out_path)
    return out_path


@scoped
def encode_file(
    spark: SparkSession,
    path: str,
    out_dir: str,
    fraction: float = 0.1,
    max_length: int = 128,
    vocabulary_size: int = 5000,
    multi_line: bool = True,
) -> DataFrame:
    """Encode a CSV file into train and validation splits; returns the written dataset."""
    rows = identified(load_checked(spark, path, multi_line=multi_line))
    encoded = encode_splits(rows, ROW_ID, fraction, vocabulary_size, max_length).drop(ROW_ID)
    stored = [c for c in ("labels", "toxic_positivity") if c in encoded.columns]
    write_splits(encoded.withColumns({c: F.col(c).cast("bigint") for c in stored}), out_dir)
    return spark.read.parquet(out_dir)
