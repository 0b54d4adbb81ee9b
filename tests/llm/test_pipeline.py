import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_dedup import brute_near
from test_lines_mixing import brute_lines, brute_mix

import __spark_entry__ as spark_entry
import corpus_pipeline
from textprep.llm.packing import END_OF_TEXT, cut
from textprep.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def corpus(words):
    """Rows (id, text, source) and the toxic ids among them: copies, shared lines, hot source."""
    rnd = random.Random(11)
    rows, toxic = [], set()
    for i in range(240):
        text = words(rnd.randint(30, 80))
        if i % 6 == 0:
            toxic.add(i)
            for _ in range(4):
                text.insert(rnd.randint(0, len(text)), rnd.choice(["grimlout", "vilebeast", "vilefoe"]))
        lines = [" ".join(text)]
        if i % 3 == 1:
            lines.insert(0, "  A Shared Footer line")
        rows.append((i, "\n".join(lines), "hot" if i % 3 else f"s{i % 4}"))
    clean = [r for r in rows if r[0] not in toxic]
    for k in range(30):  # near copies
        base = clean[k % 5][1].split(" ")
        base[len(base) // 2] = f"new{k}"
        rows.append((1000 + k, " ".join(base), "copies"))
    rows += [(2000, None, "s1"), (2001, "", None), (2002, "one", None), (2003, "long " * 5000, "s2")]
    return rows, toxic


def test_run_against_brute_force(spark, make_docs, corpus, tmp_path):
    rows, toxic = corpus
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i in toxic)) for i, _, _ in rows if i < 1000]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    clean = {r.doc_id for r in first.collect()}
    assert not clean & toxic and len(clean) >= 0.97 * (len(rows) - len(toxic))
    kept = [r for r in rows if r[0] in clean]
    texts = [t for t, _, _ in brute_lines([t for _, t, _ in kept], 10)]
    kept = [(i, t, s) for (i, _, s), t in zip(kept, texts)]
    kept = [r for r, (_, _, _, first) in zip(kept, brute_near([t for _, t, _ in kept], 5, 80)) if first]
    sizes, target = brute_mix(kept)
    copies, start = Counter(), Counter()
    for i, text, source in sorted(kept, key=lambda r: hashlib.md5(f"mix|{r[0]}".encode()).hexdigest()):
        n, total = len(text.split()), sizes[source]
        if n:
            epochs, rest = divmod(int(target[source] + 0.5), total)
            copies[i] = epochs + (start[source] < rest)
            start[source] += n
    encoder, want = Encoder(default_path()), Counter()
    for i, text, _ in kept:
        ids = np.append(encoder.encode(text), np.uint32(END_OF_TEXT))
        for piece, (begin, length) in enumerate(cut(len(ids), 2048)):
            crc = zlib.crc32(ids[begin : begin + length].astype("<u4").tobytes())
            want[i, piece, begin, length, crc] += copies[i]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    fill = Counter()
    for r in sorted(got, key=lambda r: r.offset):
        assert fill[r.sequence_id] == r.offset
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_stages_keep_the_columns_of_documents(spark, make_docs, corpus, tmp_path):
    docs = make_docs(corpus[0][:40])
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_operators_are_registered_once_each():
    names = [q for q in spark_entry.queries() if q.startswith("op")]
    numbers = [int(q[2:].split("_")[0]) for q in names if q[2:].split("_")[0].isdigit()]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in spark_entry.queries()


def test_repeated_rows_and_rows_that_share_id_and_text(spark, words):
    """One row of each group stays; rows that differ in any column are mixed each by itself."""
    text, other = " ".join(words(30)), " ".join(words(30))
    rows = [(5, text, "a"), (5, text, "a"), (5, text, "b"), (9, text + " more", "a"), (None, other, "a")]
    rows += [(None, other, "a"), (7, None, "a"), (7, "", "a"), (7, " ", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    got = [tuple(r) for r in kept.collect()]
    assert sum(r[:2] == (5, text) for r in got) == 1 and sum(r[0] == 9 for r in got) == 0
    assert got.count((None, other, "a")) == 1 and sum(r[0] == 7 for r in got) == 3 and len(got) == 5
    pair = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "y")], docs.schema)
    mixed = [tuple(r) for r in corpus_pipeline.mix_sources(spark, pair, "").collect()]
    assert {r[2] for r in mixed} == {"x", "y"} and all(r[:2] == (1, "a b c") for r in mixed)
