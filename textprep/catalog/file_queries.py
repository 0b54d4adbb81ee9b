"""Files: quoted line breaks, row identity, and the runs from files to files."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.catalog import inputs
from textprep.catalog.inputs import with_views
from textprep.catalog.registry import query
from textprep.catalog.table_queries import PARSED, _first_sql, sql_quota
from textprep.catalog.text_queries import sql_normalize, sql_variant
from textprep.operators import combine, sampling
from textprep.operators.identity import ROW_ID, identified
from textprep.plans import jobs, runs
from textprep.schema import label_codes
from textprep.sources import dataset, files
from textprep.streaming import prepare as streaming

#: Small enough that the files of every scale are cut inside records.
SPLIT_BYTES = 1 << 18

_QUOTED_SQL = "replace(text, '. ', '.\",' || chr(10) || '\"\"x, ')"


def _quoted():
    """Texts with separators, line breaks and quotes, single and doubled."""
    return F.replace("text", F.lit(". "), F.lit('.",\n""x, ')).alias("text")


@query(with_views("corpus") + f"SELECT doc_id, {_QUOTED_SQL} AS text, lang, label FROM corpus")
def read_multiline_csv(spark, sf_dir):
    path = files.scratch_path(spark, "multiline")
    corpus = inputs.corpus(spark, sf_dir).select("doc_id", _quoted(), "lang", "label")
    files.write_csv(corpus, path)
    schema = "doc_id long, text string, lang string, label int"
    return files.read_csv(spark, path, schema, split_bytes=SPLIT_BYTES)


@query(with_views("corpus", "lines") + "SELECT replace(raw, ';;', ';' || chr(10)) AS raw FROM lines")
def read_multiline_lines(spark, sf_dir):
    path = files.scratch_path(spark, "multiline-raw")
    broken = F.replace("raw", F.lit(";;"), F.lit(";\n"))
    quoted = F.concat(F.lit('"'), F.replace(broken, F.lit('"'), F.lit('""')), F.lit('"'))
    inputs.lines(spark, sf_dir).select(quoted.alias("value")).write.text(path)
    return files.read_lines(spark, path, multi_line=True)


def _content_sql(*columns: str) -> str:
    """``row_id`` of a table whose rows have no id."""
    parts = [
        f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in columns
    ]
    copy = f"row_number() OVER (PARTITION BY {', '.join(columns)}) - 1"
    return f"md5({' || '.join(parts)}) || '-' || ({copy})::VARCHAR"


_BY_CONTENT = (
    ", labelled AS (SELECT text, label_str, label, "
    + _content_sql("text", "label_str", "label")
    + " AS row_id FROM parsed WHERE label IN (0, 1)), keyed AS (SELECT *, md5(row_id || '|42') AS key FROM "
    "labelled), ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key, row_id) AS rank "
    "FROM keyed), sizes AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)"
)


def _rows_of_folder(spark, sf_dir, n_places: int):
    """Parsed lines from files of very different sizes, named by their content.

    Most lines lie in one place; each task writes a file for every place, so none writes or reads a
    place as a whole.
    """
    path = files.scratch_path(spark, "folder")
    place = F.when(F.col("doc_id") % 5 > 0, 0).otherwise(F.col("doc_id") % n_places).alias("place")
    inputs.lines(spark, sf_dir).select("raw", place).write.partitionBy("place").text(path)
    parsed = jobs.parse_lines(files.read_text_lines(spark, path), label_codes("english"))
    return identified(combine.keep_labels(parsed.select("text", "label_str", "label")))


@query(
    with_views(*PARSED) + _BY_CONTENT
    + " SELECT text, label_str, label, row_id FROM ranked WHERE rank <= (SELECT min(n) FROM sizes)"
)
def sample_of_folder(spark, sf_dir):
    """Rows without ids, named by content: the sample is the same for any cut into files."""
    return sampling.undersample(_rows_of_folder(spark, sf_dir, 7), [ROW_ID])


@query(
    with_views(*PARSED) + _BY_CONTENT + ", " + sql_quota(0.2)
    + " SELECT text, label, row_id, CASE WHEN rank <= quota THEN 'validation' ELSE 'train' END AS split "
    "FROM ranked JOIN quota USING (label)"
)
def split_of_folder(spark, sf_dir):
    split = sampling.stratified_split(_rows_of_folder(spark, sf_dir, 11), [ROW_ID], 0.2)
    return split.select("text", "label", ROW_ID, "split")


@query(
    with_views(*PARSED)
    + """, n AS (SELECT 'train_parsed' AS name, label, count(*) AS n_rows FROM parsed GROUP BY label),
    least AS (SELECT min(n_rows) AS n FROM n WHERE label IN (0, 1)),
    most AS (SELECT max(n_rows) AS n FROM n WHERE label IN (0, 1))
    SELECT * FROM n
    UNION ALL SELECT 'train_balanced_under', label, least.n FROM n, least WHERE label IN (0, 1)
    UNION ALL SELECT 'train_balanced_over', label, most.n FROM n, most WHERE label IN (0, 1)"""
)
def parse_files(spark, sf_dir):
    """The rows per label of every table that the run writes."""
    raw, out = files.scratch_path(spark, "raw"), files.scratch_path(spark, "parsed")
    inputs.lines(spark, sf_dir).select("raw").write.text(raw)
    written = runs.parse_files(spark, {"train": raw}, out)
    rows = [(name, label, n) for name, counts in written.counts.items() for label, n in counts.items()]
    return spark.createDataFrame(rows, "name string, label int, n_rows long")


@query(
    _first_sql(sql_normalize("text"), "length(text) > 0 AND label IN (0, 1)").replace(
        "SELECT doc_id, source_rank, label, text FROM norm",
        "SELECT text, label, 'xx' AS lang, "
        + sql_variant(r"regexp_matches(text, '[\x{c0}-\x{24f}]')")
        + " AS variant FROM norm",
    )
)
def prepare_files(spark, sf_dir):
    """The run from files to files; equal rows differ in other columns, so these are left out."""
    paths = [files.scratch_path(spark, name) for name in ("real", "synthetic", "prepared")]
    for df, path in zip(inputs.real_and_synthetic(spark, sf_dir), paths):
        files.write_csv(df.drop("lang"), path)
    runs.prepare_files(spark, {"train": paths[0]}, paths[1], paths[2], "xx", (0xC0, 0x24F))
    out = files.read_csv(spark, f"{paths[2]}/train")
    return out.select("text", "label", "lang", "variant")


@query(
    with_views("corpus")
    + "SELECT doc_id, text, label, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM corpus"
)
def dataset_versions(spark, sf_dir):
    """The second version of a committed dataset, checked against its manifest; a third is not published."""
    path = files.scratch_path(spark, "dataset")
    split = F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split")
    rows = inputs.corpus(spark, sf_dir).select("doc_id", "text", "label", split)
    dataset.write_dataset(rows.where("split = 'train'"), path)
    dataset.write_dataset(rows, path)
    dataset.stage(rows.where("split = 'test'"), path)
    return dataset.read_dataset(spark, path, verify=True)


@query(
    with_views(*PARSED)
    + ", norm AS (SELECT " + sql_normalize("text") + " AS text, label_str, label FROM parsed "
    "WHERE label IN (0, 1)) SELECT DISTINCT text, label_str, label FROM norm WHERE length(text) > 0"
)
def stream_prepare(spark, sf_dir):
    """Lines that come in several files and batches, each text and label written once."""
    paths = [files.scratch_path(spark, f"stream-{name}") for name in ("lines", "out", "checkpoint")]
    inputs.lines(spark, sf_dir).select("raw").repartition(6).write.text(paths[0])
    streaming.run(spark, *paths, label_codes("english"), files_per_batch=2)
    return spark.read.parquet(paths[1])
