import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textprep.llm.packing import Bins, cut, pack, pack_documents, pack_lengths, sequences
from textprep.llm.token_counts import Counter, Tree, apply_edits, build, count_tokens, edit, levels, with_edits
from textprep.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_other_library(tokenizer):
    encoder = Encoder(default_path())
    rnd = random.Random(1)
    texts = ["", " ", "a  b \n c", "x <|endoftext|> y", "don't 've", "é漢🙂   x", "\t\n"]
    texts += ["".join(rnd.choice("ab' \n\t1!é漢'sre") for _ in range(80)) for _ in range(300)]
    assert all(encoder.encode(t).tolist() == tokenizer(t) for t in texts)


def test_cut_leaves_the_rest_in_front():
    assert cut(5, 8) == [(0, 5)] and cut(8, 8) == [(0, 8)]
    assert cut(17, 8) == [(0, 1), (1, 8), (9, 8)] and cut(16, 8) == [(0, 8), (8, 8)]


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 5, 5, 5, 3])  # best fit, longest first, takes four bins of ten
    assert len(Bins(np.array([4, 4, 3, 3, 2, 2, 2]), 10).fill) >= 2
    where, fill = pack_lengths(lengths, 15)
    assert (fill > 0).sum() == 2 and np.bincount(where, weights=lengths).max() <= 15
    rnd = np.random.default_rng(0)
    for _ in range(20):
        lengths = rnd.integers(300, 900, 200)
        before = Bins(lengths, 2048).fill
        where, fill = pack_lengths(lengths, 2048)
        loads = np.bincount(where, weights=lengths)
        assert loads.max() <= 2048 and loads.sum() == lengths.sum()
        assert (fill > 0).sum() <= len(before) and (fill**2).sum() >= (before**2).sum()


def test_pack_in_several_rounds(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([1, 7, 100, 300, 511, 512])) for i in range(3000)]
    table = spark.createDataFrame(rows, "key long, length long")
    got = pack(table, "key", "length", capacity=512, group_size=200)
    placed = sorted((r.sequence_id, r.offset, dict(rows)[r.key]) for r in got.collect())
    assert len(placed) == 3000
    fill, expected = {}, sum(n > 256 for _, n in rows)  # no two of these share a sequence
    for sequence, offset, length in placed:
        assert fill.get(sequence, 0) == offset
        fill[sequence] = offset + length
    assert max(fill.values()) <= 512 and len(fill) <= 1.02 * expected + 2


def test_pack_documents(make_docs, tokenizer, words):
    texts = [None, "", "a", "a", " ".join(words(1500)), "x  y", "z" * 30000] + [" ".join(words(n)) for n in range(1, 60)]
    rows = [(i % 40, t, "s") for i, t in enumerate(texts)]
    docs = make_docs(rows).withColumn("key", F.lit("mine"))
    pieces = pack_documents(docs, capacity=128, with_ids=True)
    got = pieces.collect()
    want = sorted(tuple(tokenizer(t)) + (0,) for t in texts)
    by_doc = {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 128
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sum(len(w) for w in want) == sum(r.length for r in got)
    assert sorted(tuple(r.ids) for r in got if r.piece == 0) == sorted(w[: cut(len(w), 128)[0][1]] for w in want)
    packed = {r.sequence_id: r.ids for r in sequences(pieces).collect()}
    assert all(packed[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in got)
    assert max(map(len, packed.values())) <= 128
    assert len(packed) <= -(-sum(map(len, want)) // 128) + 2
    assert pack_documents(docs.limit(0)).count() == 0


ALPHABET = "ab'rest ve \n  \t12!é漢🙂 '"


def some_text(rnd, n):
    return "".join(rnd.choice(ALPHABET) for _ in range(n))


def test_edited_counts_equal_full_counts(tokenizer):
    rnd, counter = random.Random(4), Counter(default_path())
    for _ in range(400):
        text = some_text(rnd, rnd.randint(0, 500))
        tree = Tree(*build(counter, text))
        assert tree.total == len(tokenizer(text))
        for _ in range(3):
            start, removed = rnd.randint(-2, len(text) + 2), rnd.choice([0, 1, 2, 50, 900])
            new = some_text(rnd, rnd.choice([0, 1, 3, 200]))
            at = min(max(start, 0), len(text))
            want = text[:at] + new + text[at + removed :]
            text, _ = edit(counter, text, tree, start, removed, new)
            assert text == want and tree.total == len(tokenizer(text))
            assert tree.chars == levels(tree.chars[0]) and tree.tokens == levels(tree.tokens[0])


def test_a_small_edit_encodes_little():
    counter = Counter(default_path())
    text = " ".join(f"word{i}" for i in range(20000))
    tree = Tree(*build(counter, text))
    _, encoded = edit(counter, text, tree, 100_000, 3, "new")
    assert encoded < 1000


def test_edits_from_a_table(spark, make_docs, tokenizer):
    docs = make_docs([(1, "one two three", "s"), (1, "one two three", "s"), (2, None, "s"), (None, "x", "s"), (3, "y" * 9000, "s")])
    edits = [(1, 2, 0, 3, "1"), (1, 1, 3, 0, " and"), (2, 1, 5, 5, "new text"), (None, 1, 0, 9, None), (3, 1, None, 1, "z")]
    edits = spark.createDataFrame(edits, "doc_id long, seq long, start long, removed long, inserted string")
    state = with_edits(count_tokens(docs.withColumn("edits", F.lit("mine"))).drop("edits"), edits)
    got = apply_edits(state, "edits").collect()
    texts = sorted(r.text for r in got)
    assert texts == sorted(["1 and two three"] * 2 + ["new text", "", "y" * 9000])
    assert all(r.n_tokens == len(tokenizer(r.text)) for r in got)
    assert count_tokens(docs.limit(0)).count() == 0


def test_added_tokens_get_their_ids(make_docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"a  {end}\n\n {end}  b", f"<{end}>", "<|endoftext|", "plain  text"]
    rows = {r.doc_id: r.ids for r in pack_documents(make_docs(texts), with_ids=True).collect()}
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [rows[i] for i in range(len(texts))] == [[*w, 0] for w in want]
