import random
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from textprep.operators import features as ft, model as md
from textprep.sources.files import scratch_path

WORDS = ["hope", "no", "day", "good", "lost", "war", "éa", "naïve"]


def grams(words, max_n=3):
    return [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    return [[rnd.choice(WORDS) for _ in range(rnd.randrange(14))] for _ in range(450)] + [[]]


@pytest.fixture(scope="module")
def tokens(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "i int, tokens array<string>").repartition(3)


def test_only_ngrams_of_the_vocabulary_are_built(spark, tokens, rows):
    """Most n-grams are in no vocabulary; before, each became a string and was looked up."""
    vocabulary = ft.fit_vocabulary(tokens, max_features=40)
    terms = {t.term for t in vocabulary}
    stages = PipelineModel(md.counting_stages(vocabulary))
    got = {r.i: Counter(r.grams) for r in stages.transform(tokens).select("i", "grams").collect()}
    assert got == {i: Counter(g for g in grams(words) if g in terms) for i, words in enumerate(rows)}
    path = scratch_path(spark, "counting")
    stages.write().save(path)
    again = PipelineModel.load(path).transform(tokens).select("i", "tf").collect()
    assert sorted(again) == sorted(stages.transform(tokens).select("i", "tf").collect())


def test_terms_whose_parts_are_no_terms_are_found(tokens, rows):
    terms = ["war no day", "good lost", "naïve"]
    grams_of = ft.vocabulary_grams(terms)
    got = {r.i: Counter(r.g) for r in tokens.select("i", grams_of("tokens").alias("g")).collect()}
    assert got == {i: Counter(g for g in grams(words) if g in terms) for i, words in enumerate(rows)}


@pytest.mark.parametrize("size", [3, 40, 400])
@pytest.mark.parametrize("max_n", [1, 3, 4])
@pytest.mark.parametrize("summaries", [True, False])
def test_spaced_words_and_arrays_give_the_same(monkeypatch, tokens, rows, size, max_n, summaries):
    if not summaries:
        monkeypatch.setattr(ft, "frequent_words", lambda *_: None)
    count = Counter(g for words in rows for g in grams(words, max_n))
    best = sorted(count.items(), key=lambda x: (-x[1], x[0].count(" "), x[0].encode()))[:size]
    want = [(term, term.count(" ") + 1, n) for term, n in best]
    spaced = tokens.select(F.array_join("tokens", " ").alias("tokens"))
    for df in (tokens, spaced):
        vocabulary, coded = ft.fit_coded_vocabulary(df, "tokens", size, max_n)
        assert [tuple(t) for t in vocabulary] == want
        documents = dict(ft.documents_of_terms(coded, vocabulary).collect())
        held = Counter(g for words in rows for g in set(grams(words, max_n)))
        assert documents == {i: held[term] for i, (term, _, _) in enumerate(want)}


def test_idf_is_that_of_the_vectors(tokens):
    vocabulary, coded = ft.fit_coded_vocabulary(tokens, "tokens", 60, 3)
    vectors = PipelineModel(md.counting_stages(vocabulary)).transform(tokens)
    assert ft.idf_of_terms(coded, vocabulary) == pytest.approx(ft.fit_idf(vectors), abs=1e-12)


def test_many_small_tasks_can_tell_the_frequent_words(spark):
    """Counts fall as 1 / rank. Of twice as many words as places each task left out too many."""
    rnd = random.Random(1)
    names, weights = [f"w{i}" for i in range(30_000)], [1 / (i + 1) for i in range(30_000)]
    texts = [(rnd.choices(names, weights, k=400),) for _ in range(500)]
    df = spark.createDataFrame(texts, "tokens array<string>").repartition(100)
    kept = ft.frequent_words(df, "tokens", 200)
    assert kept is not None and 200 <= kept.count() < 2000
