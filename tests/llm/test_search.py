import heapq
import math
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textprep.llm import ann, toxicity
from textprep.llm.fingerprints import BASE, K, MODULUS, WINDOW, fingerprint_edits
from textprep.llm.toxicity import Index, Terms, score_toxicity, term_hashes


def brute_nearest(rows, k, asks):
    good = [(i, v) for i, v in rows if v and len(v) == 3 and any(v) and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if asks(q):
            scored = sorted((-float(np.dot(a, b)), i) for i, b in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("leaf", [256, 4])
def test_nearest_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(ann, "LEAF", leaf)
    rnd = random.Random(1)
    rows = [(i, [float(rnd.randint(-3, 3)) for _ in range(3)]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 2.0]) for i in range(300, 360)]  # one vector many times
    rows += [(400, None), (401, [0.0] * 3), (402, [1.0, None, 2.0]), (403, [float("nan"), 1.0, 1.0]),
             (404, [float("inf"), 1.0, 1.0]), (405, [1.0]), (420, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vid", F.lit("x"))
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got == brute_nearest(rows, 7, lambda i: i % 20 == 0)


def test_recall_on_vectors_without_structure(spark):
    x = np.random.default_rng(3).normal(size=(8000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") % 80 == 0).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids"))
    found = 0
    for r in got.collect():
        scores = x @ x[r.query_id]
        scores[r.query_id] = -9
        found += len(set(r.ids) & set(np.argsort(-scores)[:20].tolist()))
    assert found >= 0.9 * 100 * 20


@pytest.mark.parametrize("n", [2000, 4000, 8000])
def test_every_query_has_all_its_rows(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") % (n // 100) == 0).groupBy("query_id").count().collect()
    assert len(got) == 100 and all(r["count"] == 20 for r in got)


def test_nearest_without_rows_or_queries(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(one, F.lit(True)).count() == 0
    assert ann.nearest(one, F.lit(False)).count() == 0


def queue_leaves(forest, query):
    """Leaves in the order of one priority queue over all trees, with their margins."""
    projected = forest.directions[:, :, : len(query)] @ query
    inner = 2**forest.depth - 1
    queue = [(-math.inf, tree, 0, 0) for tree in range(len(projected))]
    while queue:
        worst, tree, level, node = heapq.heappop(queue)
        if node >= inner:
            yield worst, tree, node - inner
            continue
        margin = projected[tree, level] - forest.medians[tree, node]
        heapq.heappush(queue, (max(worst, margin), tree, level + 1, 2 * node + 1))
        heapq.heappush(queue, (max(worst, -margin), tree, level + 1, 2 * node + 2))


def test_queries_take_the_leaves_of_the_priority_queue():
    x = np.random.default_rng(8).normal(size=(2000, 5))
    forest = ann.fit_forest(x, 30_000, float(np.linalg.norm(x, axis=1).max()), trees=4, share=0.5)
    leaf, projected = forest.leaf_of(x), forest.projected(x[:10])
    cutoff = forest.cutoffs(projected)
    for i in range(10):
        leaves = list(queue_leaves(forest, x[i]))
        last = leaves[forest.leaves - 1][0]
        assert cutoff[i] == pytest.approx(last)
        chosen = {(tree, place) for worst, tree, place in leaves if worst <= last + 1e-12}
        want = [any((tree, place) in chosen for tree, place in enumerate(row)) for row in leaf]
        got = forest.taken(projected, cutoff + 1e-12, np.full(2000, i), leaf, np.arange(2000))
        assert got.tolist() == want and 0 < sum(want) < 2000


@pytest.mark.parametrize("round_", [8192, 50])
def test_search_sends_little_from_each_task(spark, monkeypatch, round_):
    """Many leaves and queries: what leaves Python at once does not grow with queries times leaves."""
    monkeypatch.setattr(ann, "LEAF", 8)
    monkeypatch.setattr(ann, "ROUND", round_, raising=False)
    x = np.random.default_rng(2).normal(size=(12_000, 16)).round(3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    frame = type(table)
    inner = frame.mapInArrow

    def small(self, fn, schema):
        def checked(batches):
            for batch in fn(batches):
                assert batch.nbytes < 4_000_000, batch.nbytes
                yield batch

        return inner(self, checked, schema)

    monkeypatch.setattr(frame, "mapInArrow", small)
    got = ann.nearest(table, F.col("vec_id") % 60 == 0).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids"))
    found = 0
    for r in got.collect():
        scores = x @ x[r.query_id]
        scores[r.query_id] = -99
        found += len(set(r.ids) & set(np.argsort(-scores)[:20].tolist()))
    assert found >= 0.95 * 200 * 20


def brute_fingerprint(text):
    units = re.findall("[漢字]|[^ 漢字]+", text)
    h = [((x := xxhash.xxh64(u.encode(), seed=42).intdigest()) - (x >> 63 << 64)) % MODULUS for u in units]
    if len(h) < K:
        return None
    grams = []
    for i in range(len(h) - K + 1):
        v = h[i]
        for j in range(1, K):
            v = (v * BASE + h[i + j]) % MODULUS
        grams.append((v, -i))
    windows = [grams[i : i + WINDOW] for i in range(max(1, len(grams) - WINDOW + 1))]
    chosen = list(dict.fromkeys(min(w) for w in windows))
    return [v for v, _ in chosen], [-i for _, i in chosen]


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_fingerprints_against_brute_force(make_docs, words):
    texts = [" ".join(words(n)) for n in (3, 4, 7, 50, 400)] + [" ".join(["same"] * 30), "漢 字 a b c", " ".join(words(9000))]
    ids = [7, 3, -5, 100, 4, 0, 11, 50]
    rows = sorted(zip(ids, texts))
    got = fingerprint_edits(make_docs([(i, t, "s") for i, t in rows])).orderBy("id").collect()
    for n, r in enumerate(got):
        text, following = rows[n][1], rows[(n + 1) % len(rows)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        assert (r.id, r.n_chars, r.edited) == (rows[n][0], len(text), edited)
        hashes, places = brute_fingerprint(text)
        assert r.fingerprint == "".join(f"{h:08X}" for h in hashes) and list(r.positions) == places
        changed = brute_fingerprint(edited)
        if changed:
            assert r.edited_fingerprint == "".join(f"{h:08X}" for h in changed[0])
            assert r.near_edited == pytest.approx(jaccard(hashes, changed[0]))
        assert r.near_next == pytest.approx(jaccard(hashes, brute_fingerprint(following)[0]))


def test_fingerprints_guarantee_shared_runs(make_docs, words):
    run = words(K + WINDOW - 1)
    rows = [" ".join(words(a) + run + words(b)) for a, b in ((0, 50), (31, 0), (12, 9), (5, 5))]
    got = [r.fingerprint for r in fingerprint_edits(make_docs(rows)).collect()]
    sets = [{f[i : i + 8] for i in range(0, len(f), 8)} for f in got]
    assert set.intersection(*sets)


def test_fingerprints_of_unusual_rows(make_docs):
    docs = make_docs([(None, "a b c d", "s"), (1, None, "s"), (1, "x y", "s"), (1, "x y", "s"), (2, "", "s"), (3, " \n", "s")])
    got = fingerprint_edits(docs.withColumn("packed", F.lit("mine"))).collect()
    assert len(got) == 6 and sum(r.id is None for r in got) == 1
    assert len({(r.fingerprint, r.edited) for r in got if r.text == "x y"}) == 1
    assert all(r.near_edited == 1.0 for r in got if r.text in ("", " \n") and r.edited.strip() == "")
    assert all(0 <= r.near_next <= 1 for r in got)
    one = fingerprint_edits(docs.where("doc_id = 2")).first()
    assert (one.n_chars, one.edited, one.near_next) == (0, "", 1.0)
    assert fingerprint_edits(docs.limit(0)).count() == 0


def test_index_finds_the_exact_nearest():
    rnd = np.random.default_rng(0)
    terms = Terms(np.arange(60), rnd.uniform(1, 5, 60))
    rows = [np.sort(rnd.choice(60, rnd.integers(1, 9), replace=False)) for _ in range(2000)]
    vectors = [(t, terms.weigh(t, rnd.integers(1, 4, len(t)))) for t in rows]
    index = Index(list(range(2000)), [0] * 2000, vectors, terms)
    dense = np.zeros((2000, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(200):
        best, scores = index.nearest(*vectors[i], without=i)
        want = dense @ dense[i]
        want[i] = -1
        assert np.allclose(scores, np.sort(want)[::-1][: len(scores)]) and len(scores) == toxicity.NEIGHBOURS
        assert np.allclose(want[index.ids[best]], scores)


def labelled(make_docs, words, n=600):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        text = words(rnd.randint(20, 200))
        for _ in range(3 * toxic):
            text.insert(rnd.randint(0, len(text)), rnd.choice(["Vilebeast", "vilefoe,", "GRIMLOUT", "grimlouts"]))
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_by_held_out_accuracy(spark, make_docs, words):
    rows, labels = labelled(make_docs, words)
    rows += [(9001, None, "s"), (9002, "", "s"), (9003, "vilebeast grimlout", "s"), (None, "nice", "s"), (5, rows[5][1], "s")]
    table = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    docs = make_docs(rows).withColumn("score", F.lit("old")).withColumn("text_", F.lit("mine"))
    got = score_toxicity(docs, table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.text_ == "mine" for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in got)
    one = next(r for r in got if r.doc_id == 9003)
    assert one.predicted == 1 and all(e.toxic == truth[e.doc_id] for e in one.evidence)
    assert {r.score for r in got if r.doc_id in (9001, 9002)} == {next(r.score for r in got if r.doc_id is None)}


def test_a_sent_model_needs_no_copy_of_the_package(spark, tmp_path):
    """The bytes are loaded by a process that cannot import it, and answer as here."""
    vectors = [(np.array([0, 1]), np.array([0.6, 0.8])), (np.array([1]), np.array([1.0]))]
    terms = Terms(np.arange(4), np.ones(4))
    index = Index([7, 3], [1, 0], vectors, terms)
    model = toxicity.Model(index, 0.5, 0.1, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    (tmp_path / "model").write_bytes(toxicity.sent(spark, model).value)
    code = (
        "import pickle, numpy as np, importlib.util as u; assert u.find_spec('textprep') is None; "
        "m = pickle.load(open('model', 'rb')); print(m.score(np.array([0, 1]), np.array([1, 1])))"
    )
    run = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert run.stdout.strip() == str(model.score(np.array([0, 1]), np.array([1, 1]))), run.stderr


def test_equally_near_examples_are_chosen_by_content():
    vectors = [(np.array([0]), np.array([1.0])) for _ in range(40)]
    labels = [i % 2 for i in range(40)]
    terms = Terms(np.arange(4), np.ones(4))
    for ids in (list(range(40)), list(range(40))[::-1]):
        best, _ = Index(ids, labels, vectors, terms).nearest(np.array([0]), np.array([1.0]))
        index = Index(ids, labels, vectors, terms)
        assert sum(index.labels[best]) == 0  # label 0 first, whatever the ids


def test_toxicity_without_usable_labels(spark, make_docs):
    docs = make_docs(["a b c", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in score_toxicity(docs, none).collect()] == [0.0, 0.0]
    assert score_toxicity(docs.limit(0), none).count() == 0


def test_terms_are_lower_case_letter_runs():
    assert set(term_hashes("Loser!")) == set(term_hashes(" loser ")) == set(term_hashes("(LOSER)"))
    assert len(term_hashes(None)) == len(term_hashes("ab")) == 0
