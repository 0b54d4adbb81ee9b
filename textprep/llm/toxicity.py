"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are runs of ``GRAM`` bytes of the lower-cased text with everything but letters, digits and
non-ASCII bytes turned into single spaces, hashed to ``2 ** BITS`` numbers. Only terms that labelled
toxic examples hold more often than others (``LEAST_Z`` standard errors, at most ``MAX_TERMS``) span
the space; their document frequencies are counted over the whole table.

The examples are a bounded sample: of the labelled rows with ``crc32(id) % 5 <> 0`` about
``EXAMPLES`` by hash, or all if there are fewer; copies of a text are one example. Their postings are cut into blocks of ``BLOCK``
examples with the largest weight of each term, so blocks that cannot hold one of the ``NEIGHBOURS``
nearest are never scored. Neighbours vote with the square of their similarity; votes are turned into
probabilities by the share of toxic examples among votes of that height, each example voting without
itself. A text without any term gets the share of toxic ones among such examples.

Scores depend on the text alone. Null is the empty text. Repeated ids are rows of their own; of
several labels of one id the largest counts. Without usable labels every score is 0. Further
columns are kept; ``score``, ``predicted``, ``held_out`` and ``evidence`` replace columns of these
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textprep.llm.common import Scratch, packed, quoted, sliced, unpacked

GRAM, BITS = 6, 20
EXAMPLES = 40_000
MAX_TERMS, LEAST_Z, LEAST_DOCS = 4096, 4.0, 3
NEIGHBOURS, BLOCK = 15, 128
FIRST = 4  # blocks scored before any is left out
PRIOR_WEIGHT = 0.5
BINS = 40
FOLDS = 5
#: Term vectors whose answer a task remembers; most texts hold no term or a few.
REMEMBERED = 50_000

LETTERS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def term_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode().translate(LETTERS).split()
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    n = len(data) - GRAM + 1
    if n < 1:
        return np.empty(0, np.int64)
    value = np.zeros(n, np.uint64)
    for j in range(GRAM):
        value = value * np.uint64(257) + data[j : j + n]
    return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


@dataclass
class Terms:
    """``number`` of each hash (-1: none) and idf by number."""

    number: np.ndarray
    idf: np.ndarray

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = self.number[term_hashes(text)]
        return np.unique(found[found >= 0], return_counts=True)

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(counts)) * self.idf[terms]
        return weights / max(np.sqrt((weights * weights).sum()), 1e-12)


class Index:
    """Postings by term, cut at block borders, with the largest weight of a term in each block."""

    def __init__(self, ids, labels, vectors, terms: Terms) -> None:
        heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        # Which of equally near examples comes first follows from their contents, never from ids.
        content = [xxhash.xxh3_64_intdigest(t.tobytes() + w.tobytes()) for t, w in vectors]
        order = sorted(range(len(ids)), key=lambda i: (heaviest[i], content[i], labels[i]))
        self.terms = terms
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], np.float64)
        sizes = [len(vectors[i][0]) for i in order]
        example = np.repeat(np.arange(len(order)), sizes)
        term = np.concatenate([vectors[i][0] for i in order] or [np.empty(0, np.int64)])
        weight = np.concatenate([vectors[i][1] for i in order] or [np.empty(0)])
        by_term = np.lexsort([example, term])
        term, self.example, self.weight = term[by_term], example[by_term], weight[by_term]
        self.blocks = -(-len(order) // BLOCK)
        cell = term * self.blocks + self.example // BLOCK
        cells = len(terms.idf) * self.blocks
        self.start = np.searchsorted(cell, np.arange(cells + 1)).astype(np.int32)
        largest = np.zeros(cells, np.float32)
        np.maximum.at(largest, cell, self.weight.astype(np.float32) * np.float32(1.000001))
        self.largest = largest.reshape(len(terms.idf), self.blocks)

    def scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Similarities of all examples of the given blocks, block by block."""
        cell = terms[:, None] * self.blocks + blocks[None, :]
        start = self.start[cell].ravel()
        size = self.start[cell + 1].ravel() - start
        posting = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        origin = np.tile((np.arange(len(blocks)) - blocks) * BLOCK, len(terms))
        place = self.example[posting] + np.repeat(origin, size)
        value = self.weight[posting] * np.repeat(np.repeat(weights, len(blocks)), size)
        return np.bincount(place, value, len(blocks) * BLOCK)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, without: int | None = None):
        """Examples and similarities, nearest first.

        The blocks of the highest bounds give a least similarity; of the others only those whose
        bounds exceed it are scored.
        """
        bound = weights @ self.largest[terms]
        order = np.argsort(-bound, kind="stable")
        best, found, least = np.empty(0, np.int64), np.empty(0), 0.0
        for some in (order[:FIRST], order[FIRST:]):
            some = some[bound[some] > least]
            if not len(some):
                break
            near = self.scores(terms, weights, some)
            here = np.flatnonzero(near > least)
            example = some[here // BLOCK] * BLOCK + here % BLOCK
            if without is not None:
                here, example = (x[self.ids[example] != without] for x in (here, example))
            best, found = np.append(best, example), np.append(found, near[here])
            keep = np.lexsort([best, -found])[:NEIGHBOURS]
            best, found = best[keep], found[keep]
            least = found[-1] if len(found) == NEIGHBOURS else 0.0
        return best, found


@dataclass
class Model:
    index: Index
    prior: float
    blank: float  # share of toxic examples among those without any term
    heights: np.ndarray  # votes and the probabilities they stand for
    chances: np.ndarray

    def vote(self, terms: np.ndarray, counts: np.ndarray, without: int | None = None):
        """The vote and its evidence: (example, similarity, label)."""
        index = self.index
        best, near = index.nearest(terms, index.terms.weigh(terms, counts), without)
        weights = near * near
        height = ((weights * index.labels[best]).sum() + PRIOR_WEIGHT * self.prior) / (
            weights.sum() + PRIOR_WEIGHT
        )
        return float(height), [
            {"doc_id": int(index.ids[i]), "similarity": float(s), "toxic": int(index.labels[i])}
            for i, s in zip(best, near)
        ]

    def score(self, terms: np.ndarray, counts: np.ndarray):
        if not len(terms):
            return self.blank, []
        height, evidence = self.vote(terms, counts)
        return float(np.interp(height, self.heights, self.chances)), evidence


def counted(docs: DataFrame, rows_of) -> DataFrame:
    """Sums of ``n`` and ``n1`` by term, each task sending a row per term it has met."""
    found = docs.mapInArrow(rows_of, "term int, n long, n1 long")
    return found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def counts_table(n: np.ndarray, n1: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(n1[some])], ["term", "n", "n1"]
    )


def informative_terms(examples: DataFrame, total: int, toxic: int) -> np.ndarray:
    """Hashes of the terms that toxic examples (``text, label``) hold more often."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, n1 = np.zeros((2, 2**BITS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                met = np.unique(term_hashes(text))
                n[met] += 1
                n1[met] += label
        yield counts_table(n, n1)

    table = counted(examples.select("text", "label"), rows).where(F.col("n1") >= LEAST_DOCS).toArrow()
    term, n, n1 = (table.column(c).to_numpy() for c in ("term", "n", "n1"))
    share = n / total
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / toxic + 1 / (total - toxic)))
    z = (n1 / toxic - (n - n1) / (total - toxic)) / error
    order = np.lexsort([term, -z])
    return term[order[z[order] >= LEAST_Z][:MAX_TERMS]].astype(np.int64)


def document_frequencies(texts: DataFrame, terms: Terms) -> np.ndarray:
    """Over every row of the table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(terms.idf), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n[terms.count(text)[0]] += 1
        yield counts_table(n, n)

    table = counted(texts, rows).toArrow()
    found = np.zeros(len(terms.idf), np.int64)
    found[table.column("term").to_numpy()] = table.column("n").to_numpy()
    return found


def example_vectors(examples: DataFrame, terms: Terms) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            found = [terms.count(t) for t in batch.column(2).to_pylist()]
            arrays = [pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in range(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays], ["id", "label", "terms", "counts"]
            )

    return examples.select("id", "label", "text").mapInArrow(
        rows, "id long, label int, terms array<long>, counts array<long>"
    )


def rising(n: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Shares n1 / n made monotone by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for a, b in zip(n, n1):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            a, b, k = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + k]
    return np.concatenate([np.full(int(k), b / a) for a, b, k in pools])


def sent(spark: SparkSession, model: Model) -> Broadcast[bytes]:
    """The model in bytes that hold its classes too: executors need no copy of this package.

    Its size is bounded by ``EXAMPLES`` and ``MAX_TERMS``.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> Model | None:
    """The model, or ``None`` without examples of both classes or without informative terms."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    id_ = F.col(quoted(doc_id))
    known = labels.select(id_.cast("long").alias("id"), F.col(quoted(label)).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (fold(F.col("id")) != 0))
    known = scratch.save(known.groupBy("id").agg(F.max("label").alias("label")), "known")
    parts = 1 << 30
    bound = int(parts * min(1.0, EXAMPLES / max(known.count(), 1)))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(parts)) < bound)
    texts = docs.select(id_.cast("long").alias("id"), F.col(quoted(text)).alias("text"))
    texts_of_known = texts.join(F.broadcast(known), "id").groupBy(F.xxhash64("text"))
    examples = texts_of_known.agg(
        F.min("id").alias("id"), F.max("label").alias("label"), F.any_value("text").alias("text")
    )
    examples = scratch.save(examples.select("id", "label", "text"), "examples")
    total, toxic = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < total:
        return None
    hashes_ = informative_terms(examples, total, toxic)
    if not len(hashes_):
        return None
    number = np.full(2**BITS, -1, np.int64)
    number[hashes_] = np.arange(len(hashes_))
    terms = Terms(number, np.ones(len(hashes_)))
    frequency = document_frequencies(texts.select("text"), terms)
    terms.idf = np.log((1 + texts.count()) / (1 + frequency)) + 1

    vectors = scratch.save(example_vectors(examples, terms), "vectors")
    scratch.drop("examples")
    table = vectors.toArrow().to_pydict()
    rows = [(np.array(t, np.int64), np.array(c)) for t, c in zip(table["terms"], table["counts"])]
    some = [i for i, (t, _) in enumerate(rows) if len(t)]
    blank = [table["label"][i] for i, (t, _) in enumerate(rows) if not len(t)]
    index = Index(
        [table["id"][i] for i in some], [table["label"][i] for i in some],
        [(rows[i][0], terms.weigh(*rows[i])) for i in some], terms,
    )
    prior = toxic / total
    of_blank = (sum(blank) + prior) / (len(blank) + 1)
    model = Model(index, prior, of_blank, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    shared = sent(spark, model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cloudpickle.loads(shared.value)
        n, n1 = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for i, y, t, c in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if t:
                    height = model.vote(np.array(t), np.array(c), without=i)[0]
                    n[min(int(height * BINS), BINS - 1)] += 1
                    n1[min(int(height * BINS), BINS - 1)] += y
        yield counts_table(n, n1)

    bins = counted(vectors.repartition(2 * spark.sparkContext.defaultParallelism), votes).toArrow()
    n, n1 = np.zeros((2, BINS))
    n[bins.column("term").to_numpy()] = bins.column("n").to_numpy()
    n1[bins.column("term").to_numpy()] = bins.column("n1").to_numpy()
    met = np.flatnonzero(n)
    # One pseudo-example per bin, at the height of the bin, keeps rare bins from extremes.
    middle = (met + 0.5) / BINS
    model.heights, model.chances = middle, rising(n[met] + 1, n1[met] + middle)
    return model


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """``docs`` with ``held_out``, ``score``, ``predicted`` and ``evidence`` (id, similarity, label).

    Texts are read where they lie and never shuffled. The driver holds the index of the bounded
    example sample and one number per term.
    """
    model = fit(docs, labels, doc_id, text, label)
    evidence_type = "array<struct<doc_id: long, similarity: double, toxic: int>>"
    out = packed(docs, text=text, held=F.coalesce(fold(F.col(quoted(doc_id))) == 0, F.lit(False)))
    if model is None:
        scored = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast(evidence_type).alias("evidence"))
    else:
        shared = sent(docs.sparkSession, model)

        @F.pandas_udf(f"score double, evidence {evidence_type}")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            memory: dict[bytes, tuple] = {}
            model = cloudpickle.loads(shared.value)
            for texts in batches:
                rows = []
                for t in texts:
                    terms, counts = model.index.terms.count(t)
                    key = terms.tobytes() + counts.tobytes()
                    if key not in memory:
                        if len(memory) >= REMEMBERED:
                            memory.clear()
                        memory[key] = model.score(terms, counts)
                    rows.append(memory[key])
                yield pd.DataFrame(rows, columns=["score", "evidence"])

        scored = score("text")
    out = out.withColumn("scored", scored)
    value = F.col("scored.score")
    return unpacked(
        out,
        docs.columns,
        held_out=F.col("held"),
        score=value,
        predicted=(value >= 0.5).cast("int"),
        evidence=F.col("scored.evidence"),
    )
