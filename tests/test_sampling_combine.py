import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textprep.operators import combine, sampling


def key(*parts, seed=42):
    return hashlib.md5("|".join(map(str, [*parts, seed])).encode()).hexdigest()


def labelled(spark, sizes, partitions=4):
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "id long, label int").repartition(partitions)


def test_distributed_rank_equals_brute_force(spark):
    df = labelled(spark, {0: 700, 1: 40, None: 9})
    got = {r.id: r.rank for r in sampling.distributed_rank(df, ["id"], "label").collect()}
    by_class = {}
    for r in df.collect():
        by_class.setdefault(r.label, []).append(r.id)
    want = {}
    for ids in by_class.values():
        ordered = sorted(ids, key=lambda i: (key(i), i))
        want.update({i: n for n, i in enumerate(ordered, 1)})
    assert got == want


@pytest.mark.parametrize("digits", [1, 3])
def test_one_hot_bucket(spark, digits):
    """Ranks stay exact whatever the bucket width."""
    df = labelled(spark, {0: 300})
    ranks = [r.rank for r in sampling.distributed_rank(df, ["id"], digits=digits).collect()]
    assert sorted(ranks) == list(range(1, 301))


def test_bucket_digits():
    assert [sampling.bucket_digits(n) for n in (0, 10**8, 10**9, 10**10, 10**13)] == [3, 3, 4, 5, 5]


@pytest.mark.parametrize("sizes", [{0: 500, 1: 37}, {0: 37, 1: 500}, {0: 5, 1: 5}, {0: 8}])
def test_undersample(spark, sizes):
    results = []
    for partitions in (1, 16):
        out = sampling.undersample(labelled(spark, sizes, partitions), ["id"])
        rows = [(r.id, r.label) for r in out.collect()]
        assert len(set(rows)) == len(rows)
        assert Counter(l for _, l in rows) == {c: min(sizes.values()) for c in sizes}
        results.append(sorted(rows))
    assert results[0] == results[1]
    ids = [r.id for r in labelled(spark, sizes).where("label = 0").collect()]
    first = sorted(ids, key=lambda i: (key(i), i))[: min(sizes.values())]
    assert {i for i, l in results[0] if l == 0} == set(first)


def test_seed_changes_the_sample(spark):
    df = labelled(spark, {0: 500, 1: 37})
    a, b = ({r.id for r in sampling.undersample(df, ["id"], seed=s).collect()} for s in (1, 2))
    assert a != b


@pytest.mark.parametrize("sizes", [{0: 300, 1: 11}, {0: 11, 1: 300}, {0: 6, 1: 6}])
def test_oversample(spark, sizes):
    results = []
    for partitions in (1, 16):
        out = sampling.oversample(labelled(spark, sizes, partitions), ["id"])
        results.append(sorted((r.id, r.label, -1 if r.draw is None else r.draw) for r in out.collect()))
    assert results[0] == results[1]
    top = max(sizes.values())
    assert Counter(l for _, l, _ in results[0]) == {c: top for c in sizes}
    small = 1 if sizes[0] >= sizes[1] else 0
    ids = [r.id for r in labelled(spark, sizes).where(F.col("label") == small).collect()]
    ranked = sorted(ids, key=lambda i: (key(i), i))
    for i, label, draw in results[0]:
        if label == small:
            assert i == ranked[int(key(draw, small)[:15], 16) % len(ranked)]
        else:
            assert draw == -1


def test_salted_draws_are_the_same(spark, monkeypatch):
    df = labelled(spark, {0: 300, 1: 2})
    plain = sorted(map(str, sampling.oversample(df, ["id"]).collect()))
    monkeypatch.setattr(sampling, "DRAWS_PER_KEY", 10)
    assert sorted(map(str, sampling.oversample(df, ["id"]).collect())) == plain


@pytest.mark.parametrize("fraction", [0.1, 0.2, 0.33])
@pytest.mark.parametrize("sizes", [{0: 401, 1: 58}, {0: 15, 1: 15}, {0: 10, 1: 1}])
def test_stratified_split(spark, fraction, sizes):
    results = []
    for partitions in (1, 16):
        out = sampling.stratified_split(labelled(spark, sizes, partitions), ["id"], fraction)
        results.append(sorted((r.id, r.label, r.split) for r in out.collect()))
    assert results[0] == results[1]
    n = sum(sizes.values())
    n_test = math.ceil(fraction * n)
    got = Counter(l for _, l, s in results[0] if s == "validation")
    assert len(results[0]) == n and sum(got.values()) == n_test
    for label, size in sizes.items():
        assert abs(got[label] - size * n_test / n) < 1


def test_three_classes_split(spark):
    df = labelled(spark, {0: 50, 1: 31, 2: 19})
    out = sampling.stratified_split(df, ["id"], 0.1, classes=(0, 1, 2))
    assert Counter(r.label for r in out.where("split = 'validation'").collect()) == {0: 5, 1: 3, 2: 2}


def test_split_keeps_every_label_and_null(spark):
    rows = [(i, None if i % 5 == 4 else i % 5) for i in range(200)]
    out = sampling.stratified_split(spark.createDataFrame(rows, "id long, label int"), ["id"], 0.1)
    got = Counter((r.label, r.split) for r in out.collect())
    assert sum(got.values()) == 200
    assert all(got[label, "validation"] == 4 for label in (None, 0, 1, 2, 3))


def test_balance_strategies(spark):
    df = labelled(spark, {0: 30, 1: 10, 2: 4})
    sizes = {s: sampling.balance(df, ["id"], s).count() for s in ("under", "over", "none")}
    assert sizes == {"under": 20, "over": 60, "none": 40}
    with pytest.raises(ValueError):
        sampling.balance(df, ["id"], "other")


def test_shuffle_and_preview(spark):
    df = labelled(spark, {0: 200})
    got = [r.id for r in sampling.shuffle_rows(df, ["id"]).collect()]
    assert got == sorted(range(200), key=lambda i: (key(i), i))
    assert [r.id for r in sampling.preview(df, ["id"], 3).collect()] == [0, 1, 2]


def test_sampling_does_not_shuffle_the_rows(spark):
    """Only ids and classes are exchanged; the text column stays in its partition."""
    df = labelled(spark, {0: 50, 1: 5}).withColumn("text", F.repeat(F.lit("x"), 10))
    path = "/".join([spark.conf.get("spark.checkpoint.dir"), "plan-input"])
    df.write.mode("overwrite").parquet(path)
    plan = (
        sampling.undersample(spark.read.parquet(path), ["id"])
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and not any("text" in line for line in exchanged)
    assert plan.count("text#") and "SortMergeJoin" not in plan


def test_union_and_dedup_keep_the_first_source(spark):
    real = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", None)], "id int, text string, label int")
    synthetic = spark.createDataFrame(
        [(1, "a", 1, 0), (4, "a", 0, 1), (5, "b", None, 1)],
        "id int, text string, label int, extra int",
    )
    union = combine.union_sources(real, synthetic)
    assert union.count() == 6 and union.where("source_rank = 0 and extra is null").count() == 3
    kept = combine.dedup_first(union, ["text", "label"], ["source_rank", "id"]).collect()
    assert sorted((r.source_rank, r.id) for r in kept) == [(0, 1), (0, 3), (1, 4)]


def test_dedup_with_one_huge_group(spark):
    """A third of the rows share one text; the plan limits groups before the exchange."""
    df = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit(1).alias("label")
    )
    out = combine.dedup_first(df, ["text", "label"], ["id"])
    assert out.count() == 20_001
    assert out.where("text = 'same'").collect()[0].id == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_clean_dataframe(spark):
    data = [(1, " a  b ", 1), (2, "a b", 1), (3, None, 1), (4, "  ", 0), (5, "é", 0), (6, "é", 0)]
    df = spark.createDataFrame(data, "id int, text string, label int")
    got = combine.clean_dataframe(df, ["id"]).collect()
    assert sorted((r.id, r.text) for r in got) == [(1, "a b"), (5, "é")]


def test_keep_labels_drops_null(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "label int")
    assert sorted(r.label for r in combine.keep_labels(df).collect()) == [0, 1]


@pytest.mark.parametrize("limit", [1000, 1])
def test_a_split_keeps_rows_where_they_are(spark, monkeypatch, limit):
    """No exchange moves texts; with too many classes for a broadcast the split is the same."""
    rows = [(i, None if i % 10 == 9 else i % 3, f"text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, label int, text string").repartition(12).cache()
    want = sampling.stratified_split(df, ["id"], 0.25)
    monkeypatch.setattr(sampling, "MAX_BROADCAST_CLASSES", limit)
    out = sampling.stratified_split(df, ["id"], 0.25)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    counts = Counter((r.label, r.split) for r in out.collect())
    quota = {0: 45, 1: 45, 2: 45, None: 15}
    assert {c: n for (c, split), n in counts.items() if split == "validation"} == quota
    if limit > 1:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(_class" in plan or "BroadcastExchange" in plan
        assert not any("Exchange hash" in line and "text" in line for line in plan.splitlines())
        assert out.rdd.getNumPartitions() == 12
    df.unpersist()
