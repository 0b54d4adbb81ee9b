import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textprep.llm import minhash_dedup
from textprep.llm.common import Scratch
from textprep.llm.components import components
from textprep.llm.minhash_dedup import near_duplicates
from textprep.llm.substring_dedup import remove_passages
from textprep.llm.suffix_dedup import remove_repeats


def brute_near(rows, k, percent):
    sets = []
    for text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if union and 100 * common >= percent * union:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(rows))]


def edited(words, rnd, share):
    return [f"e{rnd.randint(0, 10**9)}" if rnd.random() < share else w for w in words]


@pytest.mark.parametrize("small", [24, 2])
def test_near_duplicates_against_brute_force(make_docs, words, monkeypatch, small):
    monkeypatch.setattr(minhash_dedup, "SMALL", small)  # 2: all left pairs come from blocks
    rnd = random.Random(3)
    rows = [None, "", " \n", "one", "One", "one two", "ONE two", "x " * 5000]
    for size in (60, 200, 400):
        base = words(size)
        rows += [" ".join(base), " ".join(base).upper().lower()]
        rows += [" ".join(edited(base, rnd, s)) for s in (0.02, 0.04, 0.05, 0.06, 0.08) for _ in range(6)]
    rows += [" ".join(words(50)) for _ in range(20)]
    got = near_duplicates(make_docs(rows), k=2).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == brute_near(rows, 2, 80)


def test_near_duplicates_of_repeated_ids_and_clashing_columns(make_docs, words):
    text = " ".join(words(40))
    docs = make_docs([(5, text, "s"), (5, text, "s"), (5, "other text", "s"), (3, text, "s"), (None, text, "s")])
    docs = docs.withColumn("node", F.lit("mine")).withColumn("component_id", F.lit("old"))
    got = near_duplicates(docs).collect()
    assert len(got) == 5 and all(r.node == "mine" for r in got)
    assert sorted((r.component_id is None, r.component_id or 0) for r in got if r.text != text) == [(False, 5)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (7, 3)]
    scratch = Scratch(spark, "test")
    got = components(spark.createDataFrame(links, "u long, v long"), scratch).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    scratch.close()


def brute_repeats(rows, length):
    data = [(t or "").encode() for t in rows]
    seen = {}
    for x in data:
        for p in range(len(x) - length + 1):
            seen[x[p : p + length]] = seen.get(x[p : p + length], 0) + 1
    out = []
    for x in data:
        gone = [False] * len(x)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 70, 20])
def test_repeats_against_brute_force(make_docs, words, length):
    rnd = random.Random(length)
    long = " ".join(words(400))
    rows = [None, "", "short", long, long[:1500] + "é" + long[700:1300], "a" * 900, "ab" * 300, "é" * 230]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            n = rnd.choice([length - 1, length, length + 1, 2 * length, 150])
            at = rnd.randint(0, len(long) - n)
            parts += [long[at : at + n], "".join(rnd.choice("xyzé") for _ in range(rnd.randint(0, 90)))]
        rows.append("".join(parts))
    rows += [rows[10], rows[10]]
    got = remove_repeats(make_docs(rows), length=length).orderBy("doc_id").collect()
    out = [(r.repeats.n_bytes, r.repeats.n_removed, len(r.repeats.starts),
            hashlib.sha256(r.repeats.kept).hexdigest()) for r in got]
    assert out == brute_repeats(rows, length)


def test_repeats_of_repeated_rows_and_clashing_columns(make_docs, words):
    text = " ".join(words(60))
    docs = make_docs([(1, text, "s"), (1, text, "s"), (None, "tiny", "s")]).withColumn("repeats", F.lit(1))
    docs = docs.withColumn("spans", F.lit("mine"))
    got = {r.text: r for r in remove_repeats(docs).collect()}
    assert got[text].repeats.kept == b"" and got["tiny"].repeats.kept == b"tiny"
    assert got[text].spans == "mine"
    assert remove_repeats(docs.limit(0)).count() == 0


def test_passages_over_fifty_words_are_found_anywhere(make_docs, words):
    rnd = random.Random(5)
    passages = [words(51 + 7 * i) for i in range(4)]
    rows, holds = [None, "", "few words"], {}
    for n in range(40):
        own = words(rnd.randint(5, 120))
        if n % 4 < 2:
            passage = list(passages[n % 8 // 2])
            if n >= 16:
                passage[25] = "changed" + str(n)  # still similar
            holds[len(rows)] = n % 8 // 2 if n < 16 else None
            at = rnd.randint(0, len(own))
            own[at:at] = passage
        rows.append(" ".join(own))
    docs = make_docs(rows).withColumn("band", F.lit("mine"))
    got = remove_passages(docs).orderBy("doc_id").collect()
    for r in got:
        if r.doc_id not in holds:
            assert r.repeats.n_repeated == 0 and r.repeats.kept == (rows[r.doc_id] or "")
    exact = [d for d, p in holds.items() if p is not None]
    firsts = {min(d for d in exact if holds[d] == p) for p in set(holds.values()) - {None}}
    for d in exact:
        assert got[d].repeats.n_repeated >= 28
        assert (got[d].repeats.n_removed > 0) == (d not in firsts)
    assert remove_passages(docs.limit(0)).count() == 0


def test_near_passages_are_verified(make_docs, words):
    passage = words(120)
    other = list(passage)
    other[60] = "changed"
    rows = [" ".join(words(30) + passage + words(30)), " ".join(words(20) + other + words(40))]
    got = remove_passages(make_docs(rows)).orderBy("doc_id").collect()
    assert got[0].repeats.n_removed == 0 and got[0].repeats.n_repeated > 60
    assert got[1].repeats.n_removed > 60 and list(got[1].repeats.first) == [0]


@pytest.mark.parametrize("length, every", [(51, 26), (150, 38), (120, 1000)])
def test_changed_passages_go_up_to_their_ends(make_docs, words, length, every):
    passage, own = words(length), [words(40) for _ in range(3)]
    changed = [[f"c{n}x{i}" if i % every == every - 1 else w for i, w in enumerate(passage)] for n in range(3)]
    rows = [" ".join(o[:20] + p + o[20:]) for o, p in zip(own, [passage, *changed[1:]])]
    got = remove_passages(make_docs(rows)).orderBy("doc_id").collect()
    assert got[0].repeats.n_removed == 0 and got[0].repeats.n_repeated == length
    for r, o in zip(got[1:], own[1:]):
        assert r.repeats.n_removed == length and r.repeats.kept.split() == o and 0 in r.repeats.first


def test_passages_behind_a_frequent_line_are_compared(make_docs, words):
    line, rest = words(26), [words(30) for _ in range(6)]
    rows = [" ".join(words(60) + line + words(60)) for _ in range(80)]
    for n, shared in enumerate(rest):  # two documents hold each, in one of them with a changed word
        other = [*shared[:12], f"c{n}", *shared[13:]]
        rows += [" ".join(words(50) + line + s + words(50)) for s in (shared, other)]
    got = remove_passages(make_docs(rows)).orderBy("doc_id").collect()
    assert all(r.repeats.n_repeated == 0 for r in got[:80])
    for n in range(6):
        one, two = got[80 + 2 * n : 82 + 2 * n]
        assert (one.repeats.n_repeated, one.repeats.n_removed, two.repeats.n_removed) == (56, 0, 56)
        assert list(two.repeats.first) == [80 + 2 * n]


@pytest.mark.parametrize("seed", range(4))
def test_a_large_group_gives_the_spans_of_all_pairs(monkeypatch, seed):
    import numpy as np

    from textprep.llm import substring_dedup as sd

    rnd = np.random.default_rng(seed)
    base = rnd.integers(1, 2**32, (3, sd.WIDTH), dtype=np.uint32)
    base[:, sd.AROUND : sd.AROUND + 24] = base[0, sd.AROUND : sd.AROUND + 24]
    rows = base[rnd.integers(0, 3, 150)]
    for i in range(150):
        rows[i, rnd.integers(0, sd.WIDTH, 2)] = 2 * i + 1, 2 * i + 2
        ends = rnd.integers(0, 50, 2)
        rows[i, : ends[0]] = rnd.integers(1, 2**32, ends[0], dtype=np.uint32)
        rows[i, sd.WIDTH - ends[1] :] = rnd.integers(1, 2**32, ends[1], dtype=np.uint32)
    rows[:, sd.AROUND : sd.AROUND + sd.SEED] = base[0, sd.AROUND : sd.AROUND + sd.SEED]

    def spans():
        zero = np.zeros(150, np.int64)
        got = sd.spans_of(zero, np.arange(150), zero, zero + 100, rows, 80).to_pylist()
        out = {}
        for x in got:
            for key in {(x["k1"], False), (x["k1"], x["remove"])}:
                a, b = out.get(key, (999, 0))
                out[key] = min(a, x["start"]), max(b, x["stop"])
        return out

    got = spans()
    monkeypatch.setattr(sd, "SMALL", 1000)
    assert got == spans() and len(got) > 50
