"""Removal of long repeated byte strings, by prefix doubling on sampled suffixes.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else in the input,
in the same row or another. A suffix array over every byte would be sorted once per doubling; here
only sampled positions carry ranks. Of the ``SEED_BYTES``-byte strings that start in a window of
``length`` bytes, the one of least hash is its anchor (the rightmost of equal ones), so equal windows
have anchors at the same place, and one position in sixty is enough.

Ranks are 64-bit names, equal for equal strings, and every round sorts (position, rank) pairs by
rank. Round 0 ranks anchors by their seed; an anchor whose rank is unique is dropped with all its
windows. The next rounds rank blocks of ever fewer neighbouring windows by the string that all of
them share, which grows to the whole window (``BLOCKS``). A block is dropped when its rank is
unique, settled when the string it covers is repeated as a whole, and divided otherwise. One member
of each settled class goes along, as others may match a part of it.

Names are compared only among strings that agree in all names before, so equal names of different
strings need a 64-bit collision between strings that are already equal in their shared part.

Matches never cross rows. Null is the empty text; texts shorter than ``length`` lose nothing. Equal
rows are repeats of each other. Bytes are removed even inside a character, so what is kept is binary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from textprep.llm.common import Scratch, mixed64, packed, quoted, row_key, sliced, texts_of, unpacked

LENGTH = 200
SEED_BYTES = 64
#: Windows per block in the rounds after the first.
BLOCKS = (16, 1)

ROWS = "k1 long, k2 long, a int, low int, high int, g long, u long, known boolean"
ROW_NAMES = ["k1", "k2", "a", "low", "high", "g", "u", "known"]
ODD = 0x9E3779B97F4A7C15
LAST = np.uint64(2**31 - 1)


class Names:
    """Polynomial names of substrings: ``sum(code[byte] * base^i)`` by prefix sums modulo 2^64."""

    def __init__(self) -> None:
        rng = np.random.default_rng(2)
        self.codes = rng.integers(0, 2**63, 256, dtype=np.uint64)
        self.base, self.inverse = ODD, pow(ODD, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        for name, base in (("up", self.base), ("down", self.inverse)):
            powers = getattr(self, name)
            while len(powers) < n:
                step = np.uint64(pow(base, len(powers), 2**64))
                powers = np.concatenate([powers, powers * step])
            setattr(self, name, powers)

    def read(self, text: bytes) -> None:
        n = len(text)
        self.grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        codes = self.codes[np.frombuffer(text, np.uint8)]
        np.cumsum(codes * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed64((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(text: bytes, names: Names, length: int) -> tuple[np.ndarray, ...] | None:
    """Of each anchor: position, first and last start of its windows, name of its seed."""
    n, seed = len(text), min(SEED_BYTES, length)
    if n < length:
        return None
    names.read(text)
    start = np.arange(n - seed + 1)
    seeds = names.of(start, start + seed)
    ordered = (seeds & ~LAST) | (LAST - start.astype(np.uint64))
    least = sliding_min(ordered, length - seed + 1)
    anchor = (LAST - (least & LAST)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(anchor)) - 1
    return anchor[first], first, last, seeds[anchor[first]]


def named(value: np.ndarray, *more: np.ndarray) -> np.ndarray:
    for x in more:
        value = mixed64(value * np.uint64(ODD) ^ x.astype(np.uint64))
    return value


def first_round(docs: DataFrame, text: str, length: int, k1, k2) -> DataFrame:
    """One row per anchor: windows ``a - high`` to ``a - low``, names of the seed and of the whole."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch in sliced(batches, 500):
            of, parts = [], []
            for i, t in enumerate(texts_of(batch.column(2))):
                if (found := anchors(t, names, length)) is not None:
                    a, first, last, seeds = found
                    whole = named(names.of(first, last + length), a - first)
                    of.append(np.full(len(a), i))
                    parts.append((a, a - last, a - first, seeds, whole))
            if not of:
                continue
            a, low, high, g, u = (np.concatenate(c) for c in zip(*parts))
            keys = [batch.column(k).take(pa.array(np.concatenate(of))) for k in range(2)]
            places = [pa.array(c.astype(np.int32)) for c in (a, low, high)]
            hashes = [pa.array(c.view(np.int64)) for c in (g, u)]
            known = pa.array(np.zeros(len(a), bool))
            yield pa.RecordBatch.from_arrays([*keys, *places, *hashes, known], ROW_NAMES)

    return docs.select(k1, k2, quoted(text)).mapInArrow(rows, ROWS)


def next_round(wanted: DataFrame, contexts: DataFrame, size: int, length: int) -> DataFrame:
    """Blocks of ``size`` windows of what is still open, named by the text around the anchors.

    Blocks are aligned to the anchor, so the same windows of two texts fall into the same block.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch in sliced(batches, 2000):
            table = {c: batch.column(c) for c in ("k1", "k2", "a", "low", "high", "g", "known")}
            texts = texts_of(batch.column("context"))
            offset = np.cumsum([0, *map(len, texts)])[:-1] - batch.column("base").to_numpy()
            a, low, high = (table[c].to_numpy().astype(np.int64) for c in ("a", "low", "high"))
            names.read(b"".join(texts))
            first, count = low // size, high // size - low // size + 1
            of = np.repeat(np.arange(len(a)), count)
            block = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
            at = (a + offset)[of]  # the anchor in the joined contexts
            inner = names.of(at - block * size, at - (block * size + size - 1) + length)
            lo, hi = np.maximum(block * size, low[of]), np.minimum(block * size + size - 1, high[of])
            outer = names.of(at - hi, at - lo + length)
            g = named(table["g"].to_numpy().view(np.uint64)[of], block, inner)
            u = named(outer, lo, hi)
            taken = {c: table[c].take(pa.array(of)) for c in ("k1", "k2", "a", "known")}
            places = [pa.array(c.astype(np.int32)) for c in (lo, hi)]
            hashes = [pa.array(c.view(np.int64)) for c in (g, u)]
            yield pa.RecordBatch.from_arrays(
                [taken["k1"], taken["k2"], taken["a"], *places, *hashes, taken["known"]], ROW_NAMES
            )

    joined = wanted.drop("u").join(contexts, ["k1", "k2", "a"])
    return joined.mapInArrow(rows, ROWS)


def settle(rows: DataFrame, turn: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Repeated windows of this round, and the rows that the next one divides."""
    twice = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    twice = scratch.save(twice, f"ranks{turn}")
    again = rows.join(twice, "g").withColumn("row", F.monotonically_increasing_id())
    again = scratch.save(again, f"again{turn}")
    scratch.drop(f"rows{turn}")
    classes = again.groupBy("g", "u").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.max("known").alias("seen")
    )
    classes = scratch.save(classes, f"classes{turn}")
    unsettled = classes.where("n = 1 AND NOT seen").select("g").distinct()
    unsettled = scratch.save(unsettled.withColumn("unsettled", F.lit(True)), f"unsettled{turn}")
    marked = again.join(classes.drop("seen"), ["g", "u"])
    spans = scratch.save(
        marked.where("n > 1 AND NOT known").selectExpr("k1", "k2", "a", "low", "high"),
        f"spans{turn}",
    )
    open_ = marked.where("n = 1 OR row = first").join(unsettled, "g")
    wanted = open_.withColumn("known", F.col("known") | (F.col("n") > 1)).select(*ROW_NAMES)
    wanted = scratch.save(wanted, f"wanted{turn}")
    scratch.drop(f"again{turn}", f"classes{turn}", f"ranks{turn}", f"unsettled{turn}")
    return spans, wanted


def contexts_of(docs: DataFrame, text: str, wanted: DataFrame, length: int, k1, k2) -> DataFrame:
    """``k1, k2, a, base, context``: the text that the windows of an anchor cover."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            of, places, bases, parts = [], [], [], []
            lists = batch.column(3).to_pylist()
            for i, (t, anchors_) in enumerate(zip(texts_of(batch.column(2)), lists)):
                for x in anchors_:
                    of.append(i)
                    places.append(x["a"])
                    bases.append(x["a"] - x["high"])
                    parts.append(t[x["a"] - x["high"] : x["a"] - x["low"] + length])
            index = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(index), batch.column(1).take(index),
                    pa.array(places, pa.int32()), pa.array(bases, pa.int32()),
                    pa.array(parts, pa.binary()),
                ],
                ["k1", "k2", "a", "base", "context"],
            )

    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "low", "high")).alias("x"))
    texts = docs.select(k1, k2, F.col(quoted(text)).alias("text")).join(lists.hint("merge"), ["k1", "k2"])
    found = texts.mapInArrow(rows, "k1 long, k2 long, a int, base int, context binary")
    return found.dropDuplicates(["k1", "k2", "a"])


CUT = (
    T.StructType()
    .add("n_bytes", T.LongType())
    .add("n_removed", T.LongType())
    .add("starts", T.ArrayType(T.IntegerType()))
    .add("ends", T.ArrayType(T.IntegerType()))
    .add("kept", T.BinaryType())
)


@F.pandas_udf(CUT)
def without_spans(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    def cut(text, found):
        data = (text or "").encode()
        merged: list[list[int]] = []
        for start, end in sorted((x["start"], x["end"]) for x in ([] if found is None else found)):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        edges = [0, *[x for span in merged for x in span], len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
        return len(data), len(data) - len(kept), edges[1:-1:2], edges[2:-1:2], kept

    rows = [cut(t, s) for t, s in zip(texts, spans)]
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "starts", "ends", "kept"])


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``docs``, or the named columns of it, with ``repeats``: a struct of ``n_bytes``,
    ``n_removed``, the maximal removed runs as ``starts`` and ``ends``, and the ``kept`` bytes.

    Texts are shuffled twice, to the anchors that need dividing and to the final spans. Counts by
    rank are combined before they are shuffled, and the joins that mark rows can split hot ranks.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    k1, k2 = row_key(doc_id, text)
    rows = scratch.save(first_round(docs, text, length, k1, k2), "rows0")
    spans, wanted = settle(rows, 0, scratch)
    scratch.free_shuffles()
    contexts = scratch.save(contexts_of(docs, text, wanted, length, k1, k2), "contexts")
    for turn, size in enumerate(BLOCKS, 1):
        rows = scratch.save(next_round(wanted, contexts, size, length), f"rows{turn}")
        found, wanted = settle(rows, turn, scratch)
        spans = spans.union(found)
    scratch.drop("contexts")
    span = F.struct((F.col("a") - F.col("high")).alias("start"), F.expr(f"a - low + {length}").alias("end"))
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(span).alias("spans"))
    spans = scratch.save(spans, "spans")
    scratch.free_shuffles()
    joined = packed(docs, columns, k1=k1, k2=k2, text=text).join(spans.hint("merge"), ["k1", "k2"], "left")
    joined = joined.withColumn("repeats", without_spans("text", "spans"))
    return unpacked(joined, columns or docs.columns, repeats=F.col("repeats"))
