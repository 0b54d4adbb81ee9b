import random

import pytest

from textprep.llm import set_join
from textprep.llm.set_join import jaccard_links

DEFAULTS = {}
#: Every list in blocks, blocks of few sets, matrices of few columns.
TIGHT = {"SMALL": 1, "BLOCK": 3, "COLUMNS": 5}
#: No two sets form a family, or nearly all do; token counts that hardly tell.
ALONE = {"FAMILY": 101, "SMALL": 2}
LOOSE = {"FAMILY": 5, "BLOCK_TOKENS": 300}


def brute(texts, k, percent):
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    component, links = list(range(len(sets))), [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            common, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if union and 100 * common >= percent * union:
                links[i] += 1
                links[j] += 1
                low, high = sorted((component[i], component[j]))
                component = [low if c == high else c for c in component]
    return [(i, len(s), component[i], links[i]) for i, s in enumerate(sets)]


def edited(words, rnd, edits):
    words = list(words)
    for _ in range(edits):
        i = rnd.randrange(len(words))
        words[i : i + rnd.randint(0, 1)] = [f"e{rnd.randint(0, 10**9)}"] * rnd.randint(0, 2)
    return words


@pytest.mark.parametrize("limits", [DEFAULTS, TIGHT, ALONE, LOOSE])
@pytest.mark.parametrize("k, percent", [(4, 85), (1, 60)])
def test_join_against_brute_force(make_docs, words, monkeypatch, limits, k, percent):
    for name, value in limits.items():
        monkeypatch.setattr(set_join, name, value)
    rnd = random.Random(5)
    texts = [None, "", " \t", "one", "ONE", "one two", "One  two", "x " * 3000, "x " * 3]
    for size in (40, 120, 300):
        base = words(size)
        copies = [edited(base, rnd, n) for n in (0, 0, 1, 1, 2, 3, 4, 6, 9) for _ in range(4)]
        texts += [" ".join(c) for c in copies]
        texts += [" ".join(base[: size * s // 100]) for s in (95, 88, 86, 85, 84, 80)]
    shared = words(90)
    texts += [" ".join(shared + words(n)) for n in (5, 9, 14, 15, 16, 17, 20, 40, 200)]
    rnd.shuffle(texts)
    got = jaccard_links(make_docs(texts), k=k, percent=percent).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(texts, k, percent)


def test_rows_repeat_and_ids_are_missing(make_docs, words):
    text, other = " ".join(words(40)), " ".join(words(40))
    rows = [(5, text, "s"), (5, text, "s"), (5, other, "s"), (3, text, "s"), (None, text, "s"), (None, other, "s")]
    got = jaccard_links(make_docs(rows)).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == [
        (3, 36, 3, 3), (5, 36, 3, 3), (5, 36, 3, 3), (5, 36, 5, 1),
    ]
    assert sorted(tuple(r)[1:] for r in got if r.doc_id is None) == [(36, 3, 3), (36, 5, 1)]


def test_an_empty_table_and_ids_that_are_all_missing(spark, make_docs):
    assert jaccard_links(make_docs([]), "doc_id").collect() == []
    rows = [(None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, None, "s")]
    got = jaccard_links(make_docs(rows)).collect()
    assert sorted((r.n_shingles, r.component_id, r.n_links) for r in got) == [(0, None, 0), (2, None, 1), (2, None, 1)]
