import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textprep.functions import lexicons
from textprep.operators import encode as enc, metrics
from textprep.plans import jobs
from textprep.sources import files


def test_encode(spark):
    df = spark.createDataFrame(
        [(1, "b a a", "x"), (2, "", "y"), (3, None, "z"), (4, "zzz a " + "c " * 300, "w")],
        "doc_id long, text string, kept string",
    )
    ids = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "term string, id int")
    out = {r.doc_id: r for r in enc.encode_ids(df, ids, "doc_id").collect()}
    assert out[1].input_ids == [0, 5, 4, 4, 2] + [1] * 123 and out[1].kept == "x"
    assert out[1].attention_mask == [1] * 5 + [0] * 123
    for i in (2, 3):
        assert out[i].input_ids == [0, 2] + [1] * 126
        assert sum(out[i].attention_mask) == 2
    assert out[4].input_ids == [0, 3, 4] + [6] * 124 + [2]
    assert out[4].attention_mask == [1] * 128


def test_encoded_types(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    out = enc.encode_ids(df, enc.fit_ids(df), "doc_id", max_length=4)
    assert dict(out.dtypes) == {
        "doc_id": "bigint",
        "input_ids": "array<int>",
        "attention_mask": "array<tinyint>",
    }


def test_fit_ids_ranks_words(spark):
    df = spark.createDataFrame([("b b a நம்பிக்கை",), ("b a",)], "text string")
    got = {r.term: r.id for r in enc.fit_ids(df).collect()}
    assert got == {"b": 4, "a": 5, "நம்பிக்கை": 6}
    assert enc.fit_ids(df, size=1).collect()[0].term == "b"


def test_map_batches(spark):
    df = spark.range(10).withColumn("text", F.lit("a b"))
    out = enc.map_batches(df, lambda b: pd.DataFrame({"id": b["id"], "n": b["text"].str.len()}), "id long, n int")
    assert {r.n for r in out.collect()} == {3} and out.count() == 10


def test_read_lines(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('hello, world;Hope_speech;\n\n"quoted, ""x"";Hope_speech;"\n  pad ;L;\n', encoding="utf-8")
    df = files.read_lines(spark, str(path))
    assert sorted(r.raw for r in df.collect()) == [
        "  pad ;L;",
        "hello, world;Hope_speech;",
        'quoted, "x";Hope_speech;',
    ]
    path.write_text('"two\nlines;L;"\nb;L;\n', encoding="utf-8")
    assert files.read_lines(spark, str(path), multi_line=True).count() == 2


def test_csv_round_trip_keeps_awkward_texts(spark):
    texts = ['a "quoted" one', "comma, here", "line\nbreak", " spaces ", "back\\slash\\", "நல்ல", '"', "tab\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "label int, text string")
    path = files.scratch_path(spark, "csv")
    files.write_csv(df, path)
    back = files.load_checked(spark, path, schema="label int, text string")
    assert {r.label: r.text for r in back.collect()} == dict(enumerate(texts))
    assert files.read_csv(spark, path).schema["label"].dataType.typeName() == "integer"


def test_checked_and_optional_loads(spark):
    with pytest.raises(AnalysisException):
        files.load_checked(spark, files.scratch_path(spark, "absent"))
    assert files.load_optional(spark, files.scratch_path(spark, "absent")) is None
    path = files.scratch_path(spark, "csv")
    files.write_csv(spark.range(2), path)
    assert files.load_optional(spark, path).count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        files.load_checked(spark, path)


def test_float_labels_read_back(spark):
    path = files.scratch_path(spark, "labels")
    spark.createDataFrame([("a", "1.0"), ("b", None)], "text string, label string").coalesce(1).write.option("header", True).csv(path)
    df = files.read_csv(spark, path, "text string, label double").withColumn("label", F.col("label").cast("int"))
    assert sorted((r.text, r.label) for r in df.collect()) == [("a", 1), ("b", None)]


def test_splits_prune_partitions(spark):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "validation").otherwise("train"))
    path = files.scratch_path(spark, "splits")
    files.write_splits(df, path)
    part = files.read_split(spark, path, "validation", ["id"])
    assert sorted(r.id for r in part.collect()) == [0, 1, 2]
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        files.write_splits(spark.range(1), path)


def report(df):
    return {r.name: r for r in metrics.classification_report(df).collect()}


def test_classification_report(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)]
    got = report(spark.createDataFrame(pairs, "label int, prediction int"))
    assert (got["0"].precision, got["0"].recall, got["0"].f1, got["0"].support) == (0.833, 0.714, 0.769, 7)
    assert (got["1"].precision, got["1"].recall, got["1"].f1, got["1"].support) == (0.6, 0.75, 0.667, 4)
    assert (got["accuracy"].precision, got["accuracy"].f1, got["accuracy"].support) == (None, 0.727, 11)
    assert (got["macro avg"].precision, got["macro avg"].recall) == (0.717, 0.732)
    assert (got["weighted avg"].precision, got["weighted avg"].f1) == (0.748, 0.732)


def test_report_with_an_absent_class(spark):
    got = report(spark.createDataFrame([(0, 0), (1, 0), (0, 2)], "label int, prediction int"))
    assert (got["1"].precision, got["1"].recall, got["1"].support) == (0.0, 0.0, 1)
    assert (got["2"].recall, got["2"].f1, got["2"].support) == (0.0, 0.0, 0)


def test_value_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "v string")
    assert [tuple(r) for r in metrics.value_counts(df, "v").collect()] == [("b", 2), ("a", 1)]
    assert [tuple(r) for r in metrics.value_counts(df, "v", dropna=False).collect()] == [("b", 2), (None, 1), ("a", 1)]


def test_prepare(spark):
    real = spark.createDataFrame(
        [(1, " நல்ல  நாள்", 1.0), (2, "nalla", 0.0), (3, "x", 2.0), (4, None, 1.0)],
        "id int, text string, label double",
    )
    synthetic = spark.createDataFrame(
        [(1, "நல்ல நாள்", 1.0, 0), (2, "நல்ல day", 1.0, 1)],
        "id int, text string, label double, toxic_positivity int",
    )
    out = jobs.prepare([real, synthetic], ["id"], lang="ta", script="tamil")
    got = sorted((r.text, r.label, r.variant, r.lang, r.toxic_positivity) for r in out.collect())
    assert got == [
        ("nalla", 0.0, "romanized", "ta", None),
        ("நல்ல day", 1.0, "mixed", "ta", 1),
        ("நல்ல நாள்", 1.0, "native", "ta", None),
    ]
    dev = jobs.prepare([real], ["id"], lang="en")
    assert dev.count() == 2 and "variant" not in dev.columns


def test_clean_table(spark):
    df = spark.createDataFrame(
        [("Hello @you!", "Hope_speech"), ("!!!", "Hope_speech"), (None, "x"), ("ok", "not-malayalam")],
        "Comment_Text string, Label string",
    )
    got = sorted((r.text, r.label) for r in jobs.clean_table(df, "malayalam").collect())
    assert got == [("Hello", 1), ("ok", 0)]


def test_parse_and_balance(spark):
    lines = [(i, f"text {i};{'Hope_speech' if i % 5 == 0 else 'Non_hope_speech'};") for i in range(50)]
    lines += [(100, "x;not-English;"), (101, "no label")]
    df = spark.createDataFrame(lines, "id int, raw string")
    for strategy, size in (("under", 10), ("over", 40)):
        out = jobs.parse_and_balance(df, ["id"], strategy)
        assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0: size, 1: size}


def test_parse_and_relabel(spark):
    df = spark.createDataFrame([(1, "நம்பிக்கை இல்லை;Hope_speech;"), (2, "நம்பிக்கை;Hope_speech;")], "id int, raw string")
    assert {r.id: r.label for r in jobs.parse_and_relabel(df).collect()} == {1: 0, 2: 1}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, f"{'good hope' if i % 3 else 'lost war'} word{i % 7} again", int(i % 3 > 0)) for i in range(90)]
    rows += [(1000, "other language", 2), (1001, "unlabelled", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_train_baseline_with_and_without_dev(spark, labelled):
    held_out = jobs.train_baseline(labelled, ["doc_id"])
    assert set(held_out.reports) == {"dev"}
    total = {r.name: r.support for r in held_out.reports["dev"].collect()}
    assert total == {"0": 6, "1": 12, "accuracy": 18, "macro avg": 18, "weighted avg": 18}
    both = jobs.train_baseline(labelled, ["doc_id"], dev=labelled, test=labelled)
    assert set(both.reports) == {"dev", "test"}
    assert {r.name: r.f1 for r in both.reports["test"].collect()}["accuracy"] == 1.0
    texts = spark.createDataFrame([("there is hope",), ("hopeless",), ("lost war",)], "text string")
    scored = jobs.predict_with_rules(
        both.model, texts, lexicons.ENGLISH_POSITIVE, lexicons.ENGLISH_NEGATIVE
    )
    assert {r.text: r.final_pred for r in scored.collect()} == {"there is hope": 1, "hopeless": 0, "lost war": 0}


def test_encode_splits(spark, labelled):
    out = jobs.encode_splits(labelled.withColumn("label_str", F.lit("s")), "doc_id", max_length=6)
    rows = out.collect()
    assert set(out.columns) == {"doc_id", "label_str", "labels", "split", "input_ids", "attention_mask"}
    assert len(rows) == 92 and sum(r.split == "validation" for r in rows) == 10
    assert all(len(r.input_ids) == 6 == len(r.attention_mask) for r in rows)
    assert np.mean([r.input_ids[0] for r in rows]) == 0


def test_rows_that_share_an_id_are_encoded_apart(spark):
    df = spark.createDataFrame([(1, "a b", 0), (1, "c", 1), (2, None, 0)], "doc_id long, text string, label int")
    ids = enc.fit_ids(df)
    got = enc.encode_ids(df, ids, "doc_id", max_length=5).collect()
    assert sorted((r.doc_id, r.label, sum(r.attention_mask)) for r in got) == [(1, 0, 4), (1, 1, 3), (2, 0, 2)]
