"""Ranked lexical search by Block-Max MaxScore over segments of an inverted index.

A text's terms are its runs of digits, letters and characters outside ASCII, with A-Z lower-cased.
Each input task cuts its documents into segments of bounded size and writes one row per segment and
term: the posting list, in blocks of ``BLOCK`` documents that are decoded singly, with each block's
last document and greatest impact beside it. ``impact`` is ``(10^9 tf) div (1000 tf + 12 m)`` with
``m = 75 + (25 n N) div L``; a document scores the sum of ``weight * impact`` over a query's terms,
repeats included, with ``weight = floor(1000 ln((2 N + 2) / (2 df + 1)))``.

A query meets only the lists of its terms. Within a segment they are taken by falling bounds, the
greatest score a list can give. While the lists that are left can lift a new document among the best
``k``, lists are essential and are decoded as a whole. From there on no new document can enter: the
block maxima of the lists left reject candidates, and only blocks that hold one still in play are
decoded. All comparisons keep ties, so results are exact. The heaps of the segments are merged.

Null and blank texts have no terms: such documents are never found and do not count as documents,
such queries find nothing. Equal scores are ordered by id, nulls last. Rows that repeat an id are
documents and queries of their own. Empty tables give empty results. Texts are read whole; one longer
than a segment gets a segment of its own. Other columns do not enter; results have fixed columns.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from textprep.llm.common import Scratch, group_count, quoted, sliced, texts_of

K = 20
BLOCK = 128
#: A segment ends once it holds so many documents or terms; documents are 16-bit numbers within it.
SEGMENT_DOCS, SEGMENT_TERMS = 65_536, 3_000_000
#: Queries that go to a segment together.
QUERIES = 256

TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
INDEX = (
    "segment long, term binary, docs long, most long, width int, last binary, top binary, "
    "doc binary, tf binary, ids array<long>, lengths binary"
)
NAMES = [c.split()[0] for c in INDEX.split(", ")]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def length_factor(n: int, documents: int, total: int) -> int:
    return 75 + (25 * n * documents) // total


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def corpus_size(docs: DataFrame, text: str) -> tuple[int, int]:
    """Documents with a term, and all terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            counts = [len(terms_of(t)) for t in texts_of(batch.column(0))]
            columns = [[sum(n > 0 for n in counts)], [sum(counts)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "l"])

    counted = docs.select(quoted(text)).mapInArrow(rows, "n long, l long")
    n, total = counted.agg(F.sum("n"), F.sum("l")).first()
    return n or 0, total or 0


def build_index(docs: DataFrame, doc_id: str, text: str, documents: int, total: int) -> DataFrame:
    """``INDEX`` rows: one per segment and term, and one without a term that names the documents."""

    class Segment:
        def __init__(self) -> None:
            self.vocabulary: dict[bytes, int] = defaultdict()
            self.vocabulary.default_factory = self.vocabulary.__len__
            self.ids: list[int | None] = []
            self.lengths: list[int] = []
            self.found: list[np.ndarray] = []
            self.terms = 0

        def add(self, id_: int | None, terms: list[bytes]) -> None:
            found = np.fromiter(map(self.vocabulary.__getitem__, terms), np.int64, len(terms))
            self.found.append(found << 16 | len(self.ids))
            self.ids.append(id_)
            self.lengths.append(length_factor(len(terms), documents, total))
            self.terms += len(terms)

        def lists(self, number: int) -> Iterator[pa.RecordBatch]:
            lengths = np.array(self.lengths, np.int64)
            head = {"segment": number, "docs": len(self.ids), "ids": self.ids, "lengths": lengths.tobytes()}
            yield pa.RecordBatch.from_pylist([head], schema)
            pairs, tf = np.unique(np.concatenate(self.found), return_counts=True)
            self.found.clear()
            doc = (pairs & 0xFFFF).astype(np.int64)
            impact = impacts(tf, lengths[doc])
            size = len(self.vocabulary)
            starts = np.searchsorted(pairs >> 16, np.arange(size + 1))
            # Where each list's blocks begin, and where each block does.
            blocks = np.append(0, np.cumsum(-(-np.diff(starts) // BLOCK)))
            owner = np.repeat(np.arange(size), np.diff(blocks))
            begins = starts[owner] + BLOCK * (np.arange(blocks[-1]) - blocks[owner])
            ends = np.minimum(begins + BLOCK, starts[owner + 1]) - 1
            top = np.maximum.reduceat(impact, begins)
            width = 1 if tf.max() < 256 else 4

            def cut(values: np.ndarray, kind: str, edges: np.ndarray) -> pa.Array:
                offsets = (edges * np.dtype(kind).itemsize).astype("<i4")
                data = values.astype(kind)
                return pa.Array.from_buffers(
                    pa.binary(), size, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
                )

            columns = {
                "segment": pa.array(np.full(size, number)),
                "term": pa.array(list(self.vocabulary), pa.binary()),
                "docs": pa.array(np.diff(starts)),
                "most": pa.array(np.maximum.reduceat(top, blocks[:-1])),
                "width": pa.array(np.full(size, width, np.int32)),
                "last": cut(doc[ends], "<u2", blocks),
                "top": cut(top, "<u4", blocks),
                "doc": cut(doc, "<u2", starts),
                "tf": cut(tf, f"<u{width}", starts),
                "ids": pa.nulls(size, pa.list_(pa.int64())),
                "lengths": pa.nulls(size, pa.binary()),
            }
            batch = pa.RecordBatch.from_arrays([columns[c] for c in NAMES], NAMES)
            yield from sliced([batch], 5000)

    schema = pa.schema([
        ("segment", pa.int64()), ("term", pa.binary()), ("docs", pa.int64()), ("most", pa.int64()),
        ("width", pa.int32()), ("last", pa.binary()), ("top", pa.binary()), ("doc", pa.binary()),
        ("tf", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, segment = TaskContext.get().partitionId() << 24, Segment()
        for batch in sliced(batches, 500):
            for id_, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                terms = terms_of(t)
                if not terms:
                    continue
                full = len(segment.ids) == SEGMENT_DOCS
                if segment.ids and (full or segment.terms + len(terms) > SEGMENT_TERMS):
                    yield from segment.lists(number)
                    number, segment = number + 1, Segment()
                segment.add(id_, terms)
        if segment.ids:
            yield from segment.lists(number)

    source = docs.select(F.col(quoted(doc_id)).cast("long"), quoted(text))
    return source.mapInArrow(rows, INDEX)


@dataclass
class Postings:
    """One term's list in one segment; blocks are decoded when they are asked for."""

    docs: int
    most: int
    width: int
    last: np.ndarray
    top: np.ndarray
    doc: bytes
    tf: bytes
    lengths: np.ndarray
    whole: tuple[np.ndarray, np.ndarray] | None = None

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block ``i``."""
        n = min(BLOCK, self.docs - i * BLOCK)
        doc = np.frombuffer(self.doc, "<u2", n, 2 * i * BLOCK).astype(np.int64)
        tf = np.frombuffer(self.tf, f"<u{self.width}", n, self.width * i * BLOCK).astype(np.int64)
        return doc, impacts(tf, self.lengths[doc])

    def decoded(self, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is not None:
            return self.whole
        if blocks is None:
            parts = [self.block(i) for i in range(len(self.last))]
        else:
            parts = [self.block(i) for i in blocks]
        found = tuple(np.concatenate(x) for x in zip(*parts))
        if blocks is None:
            self.whole = found
        return found


def best(lists: list[tuple[int, Postings]], k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a segment and their scores: a superset of the best ``k``, all of them whole.

    ``lists`` are a query's (weight, postings), ``size`` the documents of the segment.
    """
    lists = sorted(lists, key=lambda x: -x[0] * x[1].most)
    bounds = np.array([w * p.most for w, p in lists], np.int64)
    rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what list i and the ones after it can add
    score = np.zeros(size, np.int64)

    def kth(values: np.ndarray) -> int:
        return int(np.partition(values, len(values) - k)[-k]) if len(values) >= k else 0

    least, i = 0, 0
    while i < len(lists) and rest[i] >= least:
        weight, postings = lists[i]
        doc, impact = postings.decoded()
        score[doc] += weight * impact
        i += 1
        if i < len(lists) and score.max() > rest[i]:
            least = max(least, kth(score))
    found = np.flatnonzero(score)
    partial = score[found]
    least = max(least, kth(partial))
    keep = partial + rest[i] >= least
    found, partial = found[keep], partial[keep]
    for j in range(i, len(lists)):
        weight, postings = lists[j]
        place = np.searchsorted(postings.last, found)
        inside = place < len(postings.last)
        bound = np.where(inside, weight * postings.top[np.minimum(place, len(postings.top) - 1)], 0)
        keep = partial + bound + rest[j + 1] >= least
        found, partial, place, inside = found[keep], partial[keep], place[keep], inside[keep]
        blocks = np.unique(place[inside])
        if len(blocks):
            doc, impact = postings.decoded(blocks)
            at = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
            partial = partial + np.where(doc[at] == found, weight * impact[at], 0)
        least = max(least, kth(partial))
    keep = (partial >= least) & (partial > 0)
    return found[keep], partial[keep]


def search_segment(index: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The ``k`` best documents of one segment for each query of one block of queries."""
    ids, lengths, lists = [], np.zeros(0, np.int64), {}
    rows = index.to_pylist()
    for row in rows:
        if row["term"] is None:
            ids, lengths = row["ids"], np.frombuffer(row["lengths"], "<i8")
    for row in rows:
        if row["term"] is not None:
            last = np.frombuffer(row["last"], "<u2").astype(np.int64)
            top = np.frombuffer(row["top"], "<u4").astype(np.int64)
            lists[row["term"]] = Postings(
                row["docs"], row["most"], row["width"], last, top, row["doc"], row["tf"], lengths
            )
    out = {"query": [], "id": [], "score": []}
    for query in queries.to_pylist():
        held = [(x["weight"], lists[x["term"]]) for x in query["terms"] if x["term"] in lists]
        held = [x for x in held if x[0] > 0]
        if not held:
            continue
        found, scores = best(held, k, len(ids))
        named = [(-int(s), ids[d] is None, ids[d] or 0) for d, s in zip(found, scores)]
        for score, missing, id_ in sorted(named)[:k]:
            out["query"].append(query["query"])
            out["id"].append(None if missing else id_)
            out["score"].append(-score)
    kinds = {"query": pa.int64(), "id": pa.int64(), "score": pa.int64()}
    return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """``query, term, n``: how often each query's terms occur in it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            query, term = [], []
            for q, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                found = terms_of(t)
                term += found
                query += [q] * len(found)
            arrays = [pa.array(query, pa.int64()), pa.array(term, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["query", "term"])

    terms = queries.select("query", quoted(text)).mapInArrow(rows, "query long, term binary")
    return terms.groupBy("query", "term").agg(F.count(F.lit(1)).alias("n"))


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = K,
    doc_id: str = "doc_id",
    text: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
) -> DataFrame:
    """``query_id, rank, doc_id, score``: each query's ``k`` best documents with a score above 0."""
    scratch = Scratch(docs.sparkSession, "lexical")
    documents, total = corpus_size(docs, text)
    index = build_index(docs, doc_id, text, documents, max(1, total))
    index = scratch.save(index, "index")

    numbered = queries.select(
        F.col(quoted(query_id)).cast("long").alias("query_id"),
        F.col(quoted(query_text)).alias("text"),
    )
    numbered = numbered.withColumn("query", F.monotonically_increasing_id())
    asked = queries.count()
    numbered = scratch.save(numbered, "queries", asked)
    terms = scratch.save(query_terms(numbered, "text"), "terms", 100 * asked)

    # Weights come from the lengths of the lists that some query needs.
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    weights = index.select("term", "docs").join(terms.select("term").distinct(), "term")
    weights = weights.groupBy("term").agg(F.sum("docs").alias("df")).select("term", weight.alias("w"))
    blocks = group_count(asked, QUERIES)
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")
    weighted = terms.join(weights, "term").select(
        block, "query", "term", (F.col("w") * F.col("n")).alias("weight")
    )
    weighted = scratch.save(weighted, "weighted", 100 * asked)
    asking = weighted.groupBy("block", "query").agg(
        F.collect_list(F.struct("term", "weight")).alias("terms")
    )

    # A segment gets a block of queries if it holds one of their terms.
    needed = weighted.select("block", "term").distinct()
    visits = index.select("segment", "term").join(needed, "term").select("block", "segment")
    visits = scratch.save(visits.distinct(), "visits")
    postings = index.join(needed, "term").select("block", *NAMES)
    heads = index.where("term IS NULL").join(visits, "segment").select("block", *NAMES)
    parts = postings.union(heads).groupBy("segment", "block")
    sent = asking.join(visits, "block").select(
        F.col("segment").alias("at"), F.col("block").alias("of"), "query", "terms"
    )
    heaps = parts.cogroup(sent.groupBy("at", "of")).applyInArrow(
        lambda one, two: search_segment(one, two, k), "query long, id long, score long"
    )
    heaps = scratch.save(heaps, "heaps")
    scratch.drop("index")

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    merged = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = numbered.select("query", "query_id")
    return merged.join(names, "query").select("query_id", "rank", F.col("id").alias("doc_id"), "score")
