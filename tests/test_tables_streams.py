"""Grouped reports, leakage, committed datasets, the stream, SQL functions and the classifier as tables."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textprep.functions import sql
from textprep.operators import leakage, linear, metrics, model as md
from textprep.plans import jobs
from textprep.schema import label_codes
from textprep.sources import dataset, files
from textprep.streaming import prepare as streaming

ROWS = [
    ("en" if i % 3 else None, "dev" if i % 4 == 0 else "train", i % 2, (i // 2) % 2, i) for i in range(48)
]


@pytest.fixture(scope="module")
def predicted(spark):
    return spark.createDataFrame(ROWS, "lang string, split string, label int, prediction int, id int")


SETS = [("lang", "split"), ("lang",), ("split",), ()]


def test_grouped_reports_are_the_reports_of_the_groups(predicted):
    got = metrics.classification_report(predicted, dims=["lang", "split"], sets=SETS).collect()
    for bits, chosen in ((0, ("lang", "split")), (1, ("lang",)), (2, ("split",)), (3, ())):
        groups = predicted.select(*chosen).distinct().collect() if chosen else [()]
        for group in groups:
            rows = predicted
            for name, value in zip(chosen, group):
                rows = rows.where(F.col(name).eqNullSafe(value))
            want = {tuple(r) for r in metrics.classification_report(rows).collect()}
            mine = {
                (r.name, r.precision, r.recall, r.f1, r.support) for r in got
                if r.grouping == bits and all(r[n] == v for n, v in zip(chosen, group))
            }
            assert mine == want
    counts = metrics.value_counts_by(predicted, "label", ["lang", "split"], SETS).collect()
    totals = {r.label: r.n_rows for r in counts if r.grouping == 3}
    assert totals == {0: 24, 1: 24}
    nulls = [r.n_rows for r in counts if r.grouping == 1 and r.lang is None]
    assert sum(nulls) == sum(r[0] is None for r in ROWS)


def test_leakage(spark):
    rows = [
        (1, "A  text", "train"), (2, " A text ", "dev"), (3, "other", "dev"), (4, "café", "train"),
        (5, "café", "test"), (6, None, "train"), (7, None, "test"), (8, "", "dev"), (9, "A text", "dev"),
    ]
    df = spark.createDataFrame(rows, "id long, text string, split string")
    assert sorted(r.id for r in leakage.leaked_rows(df, ["id"]).collect()) == [2, 5, 9]
    report = {r.split: (r.n_rows, r.n_leaked) for r in leakage.leakage_report(df, ["id"]).collect()}
    assert report == {"dev": (4, 2), "test": (2, 1)}
    assert sorted(r.id for r in leakage.without_leakage(df, ["id"]).collect()) == [1, 3, 4, 6, 7, 8]


def table(spark, n, step=1):
    rows = [(i * step, f"t{i}", ["train", "dev", "test"][i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string, split string")


def test_a_killed_write_leaves_the_old_version(spark):
    path = files.scratch_path(spark, "dataset")
    with pytest.raises(FileNotFoundError):
        dataset.read_dataset(spark, path)
    assert dataset.write_dataset(table(spark, 9), path) == 1
    bad = table(spark, 9).withColumn("id", F.expr("if(id = 8, raise_error('killed'), id)"))
    with pytest.raises(Exception, match="killed"):
        dataset.write_dataset(bad, path)
    staged = dataset.stage(table(spark, 30), path)  # a writer that dies before it publishes
    assert dataset.read_dataset(spark, path, verify=True).count() == 9
    assert dataset.versions(spark, path) == [1]
    assert dataset.publish(spark, path, staged) == 2
    assert dataset.read_dataset(spark, path, "dev", verify=True).count() == 10
    assert dataset.read_dataset(spark, path, version=1).count() == 9
    dataset.stage(table(spark, 3), path)
    assert len(dataset.remove_unpublished(spark, path)) == 2
    assert dataset.read_dataset(spark, path, verify=True).count() == 30


def test_two_writers_and_damaged_files(spark):
    path = files.scratch_path(spark, "dataset")
    one, two = dataset.stage(table(spark, 6), path), dataset.stage(table(spark, 12), path)
    assert [dataset.publish(spark, path, s) for s in (one, two)] == [1, 2]
    assert dataset.manifest(spark, path, 1)["splits"] == dataset.checksums(table(spark, 6).repartition(5))
    assert dataset.checksums(table(spark, 6)) != dataset.checksums(table(spark, 6, step=2))
    folder = Path(path, dataset.manifest(spark, path)["folder"], "split=dev")
    next(folder.glob("*.parquet")).unlink()
    with pytest.raises(dataset.DamagedDataset, match="dev"):
        dataset.read_dataset(spark, path, verify=True)


def test_the_stream_goes_on_after_its_end_and_repeats_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    codes = label_codes("english")
    lines = ["a  b;Hope_speech;", "a b;Hope_speech;", "a b;Non_hope_speech;", "x;not-English;", ";Hope_speech;", "plain"]
    later = ["a b ;Hope_speech;", "new;Hope_speech;", "café;Non_hope_speech;", "café;Non_hope_speech;"]
    (folder / "1.txt").write_text("\n".join(lines) + "\n")
    streaming.run(spark, str(folder), out, checkpoint, codes)
    first = sorted((r.text, r.label) for r in spark.read.parquet(out).collect())
    assert first == [("a b", 0), ("a b", 1)]
    streaming.run(spark, str(folder), out, checkpoint, codes)
    assert spark.read.parquet(out).count() == 2
    (folder / "2.txt").write_text("\n".join(later) + "\n")
    streaming.run(spark, str(folder), out, checkpoint, codes, files_per_batch=1)
    got = sorted((r.text, r.label) for r in spark.read.parquet(out).collect())
    raw = files.read_text_lines(spark, str(folder)).withColumn("arrived", F.current_timestamp())
    batch = streaming.prepared(raw, codes)
    assert got == sorted((r.text, r.label) for r in batch.collect())
    assert ("café", 0) in got and len(got) == 4


def test_a_watermark_bounds_what_the_stream_remembers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("a;Hope_speech;\na;Hope_speech;\nb;Hope_speech;\n")
    out = str(tmp_path / "out")
    query = streaming.run(
        spark, str(tmp_path / "in"), out, str(tmp_path / "c"), label_codes("english"), within="1 hour"
    )
    assert spark.read.parquet(out).count() == 2
    assert any("eventTime" in p.get("eventTime", {}) or p["eventTime"].get("watermark") for p in query.recentProgress)


TEXTS = [
    None, "", " ", "Hello @you, see www.x.y #tag!", " café café　", "நல்ல nalla",
    "നാളെ", "text;with;Hope_speech;", ";;", "only", "goodHope_speech", "badNon_hope_speech",
    "xnotmalayalam", "Non_hope_speech", "நம்பிக்கை இல்லை", "It's \"quoted\" \\ back", "a\n\tb",
]


@pytest.mark.parametrize("name", sorted(sql.FUNCTIONS))
def test_sql_functions_plan_and_answer_like_the_columns(spark, name):
    function = sql.FUNCTIONS[name]
    assert sql.register(spark, {name: function}) == [name]
    second = {"lang": "english", "label_str": "Hope_speech"}
    columns = [F.lit(second[p]).alias(p) if p in second else F.col("v").alias(p) for p in function.parameters]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, v string").select("i", *columns)
    want = rows.select("i", function.expression().alias("out"))
    got = spark.sql(f"SELECT i, {name}({', '.join(function.parameters)}) AS out FROM {{rows}}", rows=rows)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (got, want)]
    assert not any("Python" in p or "UDF" in p for p in plans)
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())  # inlined into the same operators


def test_markers_are_taken_out_of_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t], "text string")
    rows = jobs.derive_and_filter(df, strip_label=True).collect()
    assert {(r.text, r.label) for r in rows} == {("good", 1), ("bad", 0), ("text;with;;", 1), ("", 0)}


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i, " ".join(f"w{(i * k + k * k) % 11}" for k in range(1, 6)) + (" good" if i % 3 else " bad"), int(i % 4 > 0)) for i in range(80)]
    rows += [(900, "", 1), (901, None, 0)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    return train, md.fit_baseline(train.select("text", "label"), max_features=60)


def test_scores_by_sql_are_the_model_s(spark, fitted):
    train, model = fitted
    own = {r.doc_id: r.margin for r in linear.margins(model, train).collect()}
    joined = {r.doc_id: (r.margin, r.prediction) for r in linear.score_by_join(train, model, "doc_id").collect()}
    labels = {r.doc_id: r.prediction for r in md.predict(model, train, "prediction").collect()}
    assert joined.keys() == own.keys()
    assert all(math.isclose(joined[i][0], own[i], abs_tol=1e-9) and joined[i][1] == labels[i] for i in own)
    sums = linear.term_contributions(train, model, "doc_id").groupBy("doc_id").agg(F.sum("contribution").alias("s"))
    intercept = linear.coefficient_table(spark, model).where("idx = -1").first().weight
    assert all(math.isclose(r.s + intercept, own[r.doc_id], abs_tol=1e-9) for r in sums.collect())


def test_the_certificate_is_the_derivative_of_the_objective(spark, fitted):
    train, model = fitted
    good = linear.certify(model, train)
    gradient = {r.term: r.gradient for r in good.gradient.collect()}
    assert len(gradient) == len(model.stages[2].vocabulary) + 1
    assert max(map(abs, gradient.values())) < 1e-3 and 0 <= good.gap < 1e-4
    # Against differences of the loss itself, away from the optimum.
    classifier = model.stages[-1]
    rows = model.transform(metrics.with_class_weight(train, "label", (0, 1))).select("features", "label", "weight").collect()
    beta = classifier.coefficients.toArray() * 0.5

    def loss(b, b0=classifier.intercept):
        total = sum(
            r.weight * (math.log1p(math.exp(-abs(m))) + max(m, 0) - r.label * m)
            for r in rows for m in [float(r.features.dot(b)) + b0]
        )
        return total / sum(r.weight for r in rows) + 0.5 / len(rows) * float(b @ b)

    assert math.isclose(loss(classifier.coefficients.toArray()), good.objective, rel_tol=1e-9)
    assert loss(beta) > good.objective - good.gap


def test_only_terms_of_the_table_are_counted_by_document(spark, fitted):
    """N-grams are looked up before they are counted, not all counted first."""
    train, model = fitted
    plan = linear.score_by_join(train, model, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("count(1)") < plan.index("Join LeftOuter") and "idx" in plan.split("count(1)")[0].splitlines()[-1]
    twice = linear.score_by_join(train.union(train), model, "doc_id")
    once = {r.doc_id: r.margin for r in linear.score_by_join(train, model, "doc_id").collect()}
    assert all(math.isclose(once[r.doc_id], r.margin, abs_tol=1e-9) for r in twice.collect())
