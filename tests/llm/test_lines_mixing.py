import hashlib

from pyspark.sql import functions as F

from textprep.llm.line_dedup import drop_common_lines
from textprep.llm.mixing import mix, mixed_documents

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    line = line.strip(SPACE)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def brute_lines(rows, least):
    seen = {}
    for i, text in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            seen.setdefault(k, set()).add(i)
    common = {k for k, docs in seen.items() if len(docs) >= least}
    out = []
    for text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_against_brute_force(make_docs):
    rows = ["Same line\nown 1", " same LINE\t\nown 2\n\nSAME line", None, "", "\n", " same line",
            "Ätna\nsame line", "ätna", "x" * 200_000 + "\nsame line", "same line"]
    got = drop_common_lines(make_docs(rows), min_docs=3).orderBy("doc_id").collect()
    want = brute_lines(rows, 3)
    assert [(r.text, r.n_lines, r.n_dropped) for r in got] == want


def test_lines_of_repeated_rows_and_clashing_columns(spark, make_docs):
    docs = make_docs([(1, "a\nb", "s"), (1, "a\nb", "s"), (None, "a\nc", "s"), (2, "a", None)])
    docs = docs.withColumn("n_lines", F.lit("old")).withColumn("k1", F.lit(0)).withColumn("h1", F.lit(0))
    got = drop_common_lines(docs, min_docs=4).collect()
    assert sorted(r.text for r in got) == ["", "b", "b", "c"]
    assert all(r.n_dropped == 1 and r.k1 == 0 and r.h1 == 0 for r in got)
    assert drop_common_lines(docs.limit(0)).count() == 0


def brute_mix(rows):
    """Targets by repeated resharing; takes from the md5 order."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        target = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return sizes, target | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def check_mix(got, rows):
    sizes, target = brute_mix(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in taken)


def test_mix_reaches_targets(make_docs, words):
    sizes = {"b": 40, "a": 3, "c": 9, None: 2, "d": 1, "Z": 5}
    rows, n = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((n, " ".join(words(1 + n % 37)) if n % 11 else None, source))
            n += 1
    got = mix(make_docs(rows), block=16)
    documents = got.documents.collect()
    check_mix(documents, rows)
    assert len(documents) == len(rows)
    segments = got.segments.orderBy("slot", "begin").collect()
    assert sum(s.words for s in segments) == sum(r.taken for r in documents)
    again = mix(make_docs(rows).repartition(7), block=16)
    assert sorted(map(tuple, documents), key=str) == sorted(map(tuple, again.documents.collect()), key=str)
    assert segments == again.segments.orderBy("slot", "begin").collect()
    # Low discrepancy: in the first half of the slots every source has about half of its slots.
    slots = sorted({(s.slot, s.source) for s in segments})
    for source in {s for _, s in slots}:
        half = sum(s == source for _, s in slots[: len(slots) // 2])
        assert abs(half - sum(s == source for _, s in slots) / 2) <= 4


def test_mix_of_one_source_empty_table_and_repeated_rows(make_docs):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "d", "x"), (None, "", "x"), (2, None, "x")]
    got = mix(make_docs(rows)).documents.collect()
    assert sorted((r.size, r.taken, r.copies) for r in got) == [
        (0, 0, 0), (0, 0, 0), (1, 1, 1), (3, 3, 3 // 3), (3, 3, 1)]
    assert mix(make_docs(rows[:0])).documents.count() == 0
    assert mix(make_docs([(1, "", "x"), (2, None, None)])).documents.agg(F.sum("taken")).first()[0] == 0


def test_mixed_documents_keep_their_columns(make_docs):
    rows = [(i, f"w{i} " * 10, "big") for i in range(30)] + [(99, "tiny one", "small")]
    docs = make_docs(rows).withColumn("copies", F.lit("mine"))
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    table = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    want = {r.id: r.copies for r in mix(docs).documents.collect() if r.copies}
    assert table == want and table[99] == 3


def test_hash_of_kept_text(make_docs):
    got = drop_common_lines(make_docs(["é\nx"]), min_docs=2).select(F.sha2(F.col("text").cast("binary"), 256))
    assert got.first()[0] == hashlib.sha256("é\nx".encode()).hexdigest()
