import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from textprep.operators import features as ft, model as md
from textprep.operators.metrics import with_class_weight
from textprep.sources.files import scratch_path


def tokens(text):
    return re.findall(r"\b\w\w+\b", text.lower())


def grams(text, max_n=3):
    t = tokens(text)
    return [" ".join(t[i : i + n]) for n in range(1, max_n + 1) for i in range(len(t) - n + 1)]


def top(texts, size, max_n=3):
    counts = Counter(g for t in texts for g in grams(t, max_n))
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0].count(" "), x[0].encode()))
    return [(g, g.count(" ") + 1, c) for g, c in ranked[:size]]


def make_texts(n, seed=0, words=12):
    rng = random.Random(seed)
    vocabulary = ["hope", "no", "day", "good", "lost", "war", "éa", "naïve", "x", "The", "aa_1"]
    return [
        " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(words))) + rng.choice(["", "!", "; "])
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def texts():
    return [*make_texts(60), "", None, "one", "one two", "one two three", "same same same same"]


@pytest.fixture(scope="module")
def corpus(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_tokens_and_ngrams(apply, texts):
    values = [t or "" for t in texts]
    assert apply(ft.word_tokens, values) == [tokens(t) for t in values]


def test_ngrams(spark, texts):
    values = [t or "" for t in texts]
    df = spark.createDataFrame([(i, tokens(t)) for i, t in enumerate(values)], "i int, t array<string>")
    got = df.select("i", ft.ngrams("t").alias("g"), ft.ngrams("t", (2, 2)).alias("two")).orderBy("i")
    for row, text in zip(got.collect(), values):
        assert row.g == grams(text)
        assert row.two == [g for g in grams(text) if g.count(" ") == 1]


def test_indic_tokens(apply):
    value = ["நம்பிக்கை இல்லை"]
    assert apply(ft.word_tokens, value) == [tokens(value[0])]
    assert apply(lambda c: ft.word_tokens(c, keep_marks=True), value) == [value[0].split()]


@pytest.mark.parametrize("size", [1, 3, 10, 40, 5000])
@pytest.mark.parametrize("max_n", [1, 3])
def test_vocabulary_equals_counting_everything(corpus, texts, size, max_n):
    df = corpus.select(ft.word_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    got = ft.fit_vocabulary(df, max_features=size, max_n=max_n)
    assert [tuple(t) for t in got] == top([t or "" for t in texts], size, max_n)


def test_vocabulary_with_many_ties(spark):
    texts = [f"w{i:02d} w{i + 1:02d} w{i + 2:02d}" for i in range(40)]
    df = spark.createDataFrame([(t.split(),) for t in texts], "tokens array<string>")
    for size in (5, 41, 60, 90):
        assert [tuple(t) for t in ft.fit_vocabulary(df, max_features=size)] == top(texts, size)


def test_empty_vocabulary(spark):
    df = spark.createDataFrame([([],)], "tokens array<string>")
    assert ft.fit_vocabulary(df) == []
    assert ft.vocabulary_table(spark, []).count() == 0


def test_term_counts(corpus, texts):
    counted = ft.term_counts(corpus, "doc_id")
    got = {(r.doc_id, r.term): r.tf for r in counted.collect()}
    want = {(i, g): c for i, t in enumerate(texts) for g, c in Counter(grams(t or "")).items()}
    assert got == want
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" in plan and "ENSURE_REQUIREMENTS" not in plan


def expected_tfidf(texts, size):
    terms = [t for t, _, _ in top(texts, size)]
    docs = [Counter(g for g in grams(t) if g in set(terms)) for t in texts]
    idf = {t: math.log((1 + len(texts)) / (1 + sum(t in d for d in docs))) + 1 for t in terms}
    rows = np.array([[d[t] * idf[t] for t in terms] for d in docs])
    norm = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def test_tfidf_vectors(corpus, texts):
    model = md.fit_features(corpus, max_features=30)
    got = {r.doc_id: r.features.toArray() for r in model.transform(corpus).collect()}
    want = expected_tfidf([t or "" for t in texts], 30)
    for i in range(len(texts)):
        assert np.allclose(got[i], want[i], atol=1e-12)


def test_long_table_equals_vectors(corpus, texts):
    model = md.fit_features(corpus, max_features=30)
    entries = ft.vector_entries(model.transform(corpus), "features", "doc_id").collect()
    want = expected_tfidf([t or "" for t in texts], 30)
    dense = np.zeros_like(want)
    for r in entries:
        dense[r.doc_id, r.idx] = r.value
    assert np.allclose(dense, want, atol=1e-12)


def test_document_frequency(corpus):
    model = md.fit_features(corpus, max_features=30)
    counted = model.transform(corpus)
    got = {r.idx: r.df for r in ft.document_frequency(counted).collect()}
    want = Counter(i for r in counted.select("tf").collect() for i in r.tf.indices.tolist())
    assert got == dict(want)


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(5)
    rows = []
    for i, t in enumerate(make_texts(160, seed=3)):
        label = int("hope" in t.split()) if rng.random() < 0.9 else rng.randrange(2)
        rows.append((i, t, label))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def newton(x, y, weights, steps=60):
    """Minimum of sum(w * logloss) + |b|^2 / 2 with a free intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.eye(x.shape[1])
    penalty[-1, -1] = 0
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        gradient = x.T @ (weights * (p - y)) + penalty @ b
        hessian = (x.T * (weights * p * (1 - p))) @ x + penalty
        b -= np.linalg.solve(hessian, gradient)
    return b


def test_regression_solves_the_stated_problem(training):
    model = md.fit_baseline(training, max_features=15)
    rows = with_class_weight(model.transform(training)).collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.label for r in rows])
    w = np.array([r.weight for r in rows])
    assert math.isclose(w.sum(), len(rows))
    lr = model.stages[-1]
    want = newton(x, y, w)
    assert np.allclose(np.append(lr.coefficients.toArray(), lr.intercept), want, atol=5e-3)


def test_model_beats_majority_and_survives_saving(spark, training):
    model = md.fit_baseline(training, max_features=200)
    scored = md.predict(model, training)
    assert scored.columns == ["doc_id", "text", "label", "base_pred"]
    hits = scored.where("label = base_pred").count()
    assert hits > max(r["count"] for r in training.groupBy("label").count().collect())
    path = scratch_path(spark, "model")
    md.save_model(model, path)
    loaded = md.load_model(path)
    assert isinstance(loaded, PipelineModel)
    assert sorted(md.predict(loaded, training).collect()) == sorted(scored.collect())


def test_no_terms_is_an_error(spark):
    with pytest.raises(ValueError, match="no terms"):
        md.fit_features(spark.createDataFrame([("a !",), (None,)], "text string"))


def test_weights_keep_rows_of_other_classes(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (2,), (None,)], "label int")

    def weights(**kwargs):
        rows = with_class_weight(df, **kwargs).collect()
        return sorted(((r.label, r.weight and round(r.weight, 6)) for r in rows), key=str)

    two = weights(classes=(0, 1))
    assert two == [(0, 0.666667)] * 3 + [(1, 2.0), (2, None), (None, None)]
    assert weights() == [(0, 0.555556)] * 3 + [(1, 1.666667), (2, 1.666667), (None, None)]


def test_columns_and_names_of_the_user_do_not_clash(spark, training):
    model = md.fit_baseline(training.withColumnRenamed("text", "my text"), "my text", max_features=50)
    table = training.withColumnRenamed("text", "my text").withColumn("tokens", F.lit("own"))
    scored = md.predict(model, table.withColumn("prediction", F.lit(7)))
    assert scored.columns == [*table.columns, "prediction", "base_pred"]
    assert {(r.tokens, r.prediction) for r in scored.collect()} == {("own", 7)}


@pytest.mark.parametrize("summary", [2, 1])
@pytest.mark.parametrize("size", [1, 5, 12, 40, 300])
def test_summaries_of_tasks_give_the_exact_vocabulary(spark, monkeypatch, summary, size):
    """Also where a task forgets words again and again, and where the summaries cannot tell."""
    monkeypatch.setattr(ft, "SUMMARY", summary)
    rnd = random.Random(size)
    vocabulary = [f"w{i}" for i in range(250)]
    weights = [1 / (i + 1) for i in range(250)]
    rows = [(rnd.choices(vocabulary, weights, k=rnd.randint(0, 30)),) for _ in range(400)] + [(None,), ([],)]
    df = spark.createDataFrame(rows, "tokens array<string>").repartition(5)
    total = Counter(w for (words,) in rows for w in words or [])
    want = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]
    got = ft.fit_vocabulary(df, max_features=size, max_n=1)
    assert [(t.term, t.total) for t in got] == want
    kept = ft.frequent_words(df, "tokens", size)
    if kept is not None:
        assert {w for w, _ in want} <= {r.term for r in kept.collect()}


def test_vocabulary_sizes_are_limited(spark):
    df = spark.createDataFrame([(["a"],)], "tokens array<string>")
    for size in (0, ft.MAX_VOCABULARY + 1):
        with pytest.raises(ValueError):
            ft.fit_vocabulary(df, max_features=size)


def test_parts_of_counted_documents_grow_with_their_texts(corpus, texts, monkeypatch):
    monkeypatch.setattr(ft, "TEXT_PER_TASK", 100, raising=False)
    size = sum(len((t or "").encode()) for t in texts)
    counted = ft.term_counts(corpus.union(corpus), "doc_id")
    assert counted.rdd.getNumPartitions() == 2 * size // 100 + 1
    got = {(r.doc_id, r.term): r.tf for r in counted.collect()}
    assert got == {(i, g): 2 * c for i, t in enumerate(texts) for g, c in Counter(grams(t or "")).items()}


def test_words_are_summarised_in_small_batches(spark, monkeypatch):
    seen = []
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    stored = ft.materialize
    monkeypatch.setattr(ft, "materialize", lambda df, what: seen.append(int(spark.conf.get(name))) or stored(df, what))
    before = spark.conf.get(name)
    df = spark.createDataFrame([(["a", "b", "a"],)] * 3, "tokens array<string>")
    assert [tuple(t) for t in ft.fit_vocabulary(df, max_n=1)] == [("a", 1, 6), ("b", 1, 3)]
    assert seen and max(seen) <= 200 and spark.conf.get(name) == before
