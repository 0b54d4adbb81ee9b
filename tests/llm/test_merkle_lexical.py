import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from textprep.llm import lexical, merkle
from textprep.llm.lexical import search
from textprep.llm.merkle import build_manifest, folded, prove, siblings_digest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """The root over ``nodes`` and each node's siblings, level by level."""
    steps, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for i, p in enumerate(places):
            run = runs[p // 8]
            steps[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            places[i] = p // 8
        nodes = [h("".join(run)) for run in runs]
    return nodes[0], steps


def expected(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    named = [(lang, id_, h("".join(field(v) for v in (id_, lang, text)))) for id_, text, lang in rows]
    first = lambda v: (v is not None, v)
    langs = sorted({lang for lang, _, _ in named}, key=lambda v: (v is not None, (v or "").encode()))
    parts = [sorted((first(i), d) for l, i, d in named if l == lang) for lang in langs]
    built = [climb([d for _, d in part]) for part in parts]
    root, tops = climb([subroot for subroot, _ in built])
    out = []
    for part, (subroot, steps), top in zip(parts, built, tops):
        out += [(key[1], d, subroot, root, s + top) for (key, d), s in zip(part, steps)]
    return out


@pytest.fixture(scope="session")
def manifest_of(spark):
    def make(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        docs = docs.withColumn("part", F.lit("mine")).withColumn("digest", F.lit("mine"))
        digest = merkle.leaf(F.col("doc_id"), F.col("lang"), F.col("text"))
        return build_manifest(docs, digest, doc_id=F.col("doc_id"))

    return make


def rows_of(*counts):
    """Documents with 0, 1, 8, 9, 64 and 65 leaves to a language, some null."""
    rnd = random.Random(4)
    rows = []
    for n, lang in zip(counts, [None, "", "de", "é", "z", "zz", "Z", "a", "b", "c"]):
        rows += [(rnd.choice([i * 7, i * 7, None]), rnd.choice(["tÄxt", "", None, "a" * 50_000]), lang) for i in range(n)]
    return rows


@pytest.mark.parametrize("counts", [(1,), (8,), (9,), (1, 1), (65, 1, 64, 9, 8, 2, 7, 1, 30, 600)])
def test_proofs_against_brute_force(manifest_of, counts):
    rows = rows_of(*counts)
    rows += rows[:1] * 20 if len(counts) > 2 else []  # repeated rows are leaves of their own
    manifest = manifest_of(rows)
    got = prove(manifest, manifest.leaves).withColumn("folded", folded("path", F.col("leaf"))).collect()
    paths = [
        (r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in got
    ]
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(paths, key=key) == sorted(expected(rows), key=key)
    assert all(r.folded == r.root == manifest.root for r in got)
    children = {r.digest: r.children for r in manifest.records.collect()}
    assert all(h("".join(c)) == d and 1 <= len(c) <= 8 for d, c in children.items())


def test_some_requests_wrong_leaves_and_an_empty_table(manifest_of):
    manifest = manifest_of(rows_of(100, 3))
    some = prove(manifest, manifest.leaves.where("doc_id = 21")).collect()
    assert len(some) == manifest.leaves.where("doc_id = 21").count()
    wrong = prove(manifest, manifest.leaves).withColumn("f", folded("path", F.lit(h("forged"))))
    assert wrong.where("f = root").count() == 0
    given = wrong.select(siblings_digest("path").alias("d"), "path").collect()
    assert all(r.d == h("".join(s.left + s.right for s in r.path)) for r in given)
    empty = manifest_of([])
    assert empty.root is None and prove(empty, empty.leaves).collect() == []


def ranking(docs, items, k):
    terms = lambda t: re.findall(
        r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    )
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    n, total = len(found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for id_, t in found:
            m = 75 + 25 * len(t) * n // total
            score = 0
            for x in terms(text):
                if x in df:
                    tf = t.count(x)
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1)))
                    score += w * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, id_ is None, id_))
        best = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, rank, id_, -s) for rank, (s, _, id_) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 2, "SEGMENT_DOCS": 9, "QUERIES": 2}, {"SEGMENT_TERMS": 40}])
@pytest.mark.parametrize("k", [1, 5])
def test_search_against_brute_force(spark, monkeypatch, limits, k):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    rnd = random.Random(1)
    vocabulary = ["the", "Of", "ñandú", "x1", "ÉCLAIR", "日本", "rare"] + [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(n):
        return rnd.choice([" ", "-", "\n"]).join(rnd.choices(vocabulary, weights, k=n))

    docs = [(i, text(rnd.choice([1, 3, 10, 40]))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "... !"), (None, "rare rare"), (203, "the " * 3000), (5, docs[5][1])]
    docs += [(300 + i, docs[7][1]) for i in range(8)]  # ties
    items = [(i, text(rnd.choice([1, 4, 15]))) for i in range(9)] + [(50, None), (51, "unseen"), (52, "rare")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("mine"))
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = search(frame, asked, k).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(
        x for x in ranking(docs, items, k) if x[2] is not None
    )
    assert sum(r.doc_id is None for r in got) == sum(x[2] is None for x in ranking(docs, items, k))


def test_search_of_empty_tables_and_repeated_queries(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a"), (7, "a")], "item_id long, text string")
    assert [tuple(r)[:3] for r in search(docs, asked).collect()] == [(7, 1, 1)] * 2
    assert search(docs.limit(0), asked).collect() == search(docs, asked.limit(0)).collect() == []
