"""Best-fit packing of tokenized documents into sequences of fixed capacity.

A document is its token ids and an end-of-text id. A document over the capacity is cut so that its
last pieces are full and the first one takes the rest. Full pieces are sequences of their own; the
others are sorted by length and dealt out to groups like cards, so all groups hold the same mix of
lengths and can be packed apart from each other. Each group is packed best fit, longest first, and
improved by local search: the emptiest bin gives pieces to fuller ones by moves, one-for-one and
two-for-one exchanges, each of which raises the sum of squared fills, until it is empty or nothing
helps. A group then keeps its good bins and passes its emptiest ones on; these are dealt to fewer
groups, round by round, until one group is left.

Null texts are empty texts: one piece with the end-of-text id. Rows with equal ids or texts are
packed each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from textprep.llm.common import Scratch, group_count, quoted, sliced
from textprep.llm.tokens import Encoder, added_tokens, default_path

CAPACITY = 2048
END_OF_TEXT = 0
GROUP_SIZE = 4096  # pieces a task packs at once
PASS_ON = 16  # a group passes on at most one in so many of its pieces
FULL = 63  # "round" of sequences that one full piece makes


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with ``n`` ids."""
    first = n if n <= capacity else n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def tokenize(docs: DataFrame, doc_id: str, text: str, capacity: int, path: str, ids: bool):
    """One row per piece: the id, ``piece, start, length, ids_crc32`` and on demand ``ids``."""
    id_type = docs.schema[doc_id].dataType
    fields = [T.StructField("id", id_type)]
    fields += [T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, added_tokens(path))
        end = np.array([END_OF_TEXT], "<u4")
        for batch in sliced(batches, 500):
            rows: list[tuple[int, int, int, int, int]] = []
            tokens: list[np.ndarray] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                data = np.append(encoder.encode(t or ""), end)
                for k, (start, length) in enumerate(cut(len(data), capacity)):
                    part = data[start : start + length]
                    rows.append((i, k, start, length, zlib.crc32(part)))
                    if ids:
                        tokens.append(part.view("<i4"))
            table = np.array(rows, np.int64).reshape(-1, 5)
            out = [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1], pa.int32())]
            out += [pa.array(table[:, c]) for c in (2, 3, 4)]
            if ids:
                out.append(pa.array(tokens, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return docs.select(quoted(doc_id), quoted(text)).mapInArrow(pieces, T.StructType(fields))


class Bins:
    """Bins of one group: the bin of each piece, and the fill of each bin."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.bin = np.zeros(len(lengths), np.int64)
        self.fill = self.best_fit()

    def best_fit(self) -> np.ndarray:
        """Longest piece first, each into the fullest bin it fits in.

        ``room`` lists the bins by free space; a bit of ``some`` says where there are any.
        """
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        some, free = 0, []
        for i in np.argsort(-self.lengths, kind="stable"):
            need = int(self.lengths[i])
            fits = some >> need
            if fits:
                space = need + (fits & -fits).bit_length() - 1
                b = room[space].pop()
                if not room[space]:
                    some ^= 1 << space
            else:
                space, b = self.capacity, len(free)
                free.append(0)
            self.bin[i], free[b] = b, space - need
            if space > need:
                room[space - need].append(b)
                some |= 1 << (space - need)
        return self.capacity - np.array(free, np.int64)

    def improve(self) -> None:
        """Empty the emptiest bins into fuller ones until nothing raises the squared fills."""
        least = max(-(-int(self.fill.sum()) // self.capacity), (2 * self.lengths > self.capacity).sum())
        for victim in np.argsort(self.fill, kind="stable"):
            if (self.fill > 0).sum() <= least:
                return
            if 0 < self.fill[victim] < self.capacity:
                open_bin = (self.fill < self.capacity) & (self.fill > 0)
                others = np.flatnonzero(open_bin[self.bin] & (self.bin != victim))
                while self.fill[victim] and self.step(victim, others):
                    pass

    def step(self, victim: int, others: np.ndarray) -> bool:
        """The move or exchange that leaves the least space in the bin it fills."""
        own = np.flatnonzero(self.bin == victim)
        own = own[np.argsort(-self.lengths[own], kind="stable")][:32]
        others = others[self.bin[others] != victim]
        into = self.bin[others]
        bins = np.unique(into)
        bins = bins[self.fill[bins] >= self.fill[victim]]
        space = self.capacity - self.fill
        for i in own:  # move
            left = space[bins] - self.lengths[i]
            if (left >= 0).any():
                b = bins[np.argmin(np.where(left >= 0, left, self.capacity + 1))]
                return self.apply([i], [], victim, b)
        pairs = [[i, j] for k, i in enumerate(own[:12]) for j in own[k + 1 : 12]]
        for give in [[i] for i in own] + pairs:  # one-for-one, two-for-one
            gain = self.lengths[give].sum() - self.lengths[others]
            left = space[into] - gain
            good = (gain > 0) & (left >= 0) & (self.fill[into] >= self.fill[victim])
            if good.any():
                k = np.argmin(np.where(good, left, self.capacity + 1))
                return self.apply(give, [others[k]], victim, into[k])
        return False

    def apply(self, give: list[int], take: list[int], victim: int, b: int) -> bool:
        gain = int(self.lengths[give].sum() - self.lengths[take].sum())
        self.bin[give], self.bin[take] = b, victim
        self.fill[b] += gain
        self.fill[victim] -= gain
        return True


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and the fill of each bin."""
    bins = Bins(lengths.astype(np.int64), capacity)
    bins.improve()
    return bins.bin, bins.fill


def pack(
    pieces: DataFrame,
    key: str,
    length: str,
    capacity: int = CAPACITY,
    group_size: int = GROUP_SIZE,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``key, sequence_id, offset`` for pieces with distinct keys and lengths of 1 to ``capacity``."""
    scratch = scratch or Scratch(pieces.sparkSession, "pack")
    pieces = pieces.select(F.col(key).alias("key"), F.col(length).cast("long").alias("length"))
    full = pieces.where(F.col("length") == capacity).select(
        "key",
        F.shiftleft(F.monotonically_increasing_id(), 6).bitwiseOR(FULL).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    todo = scratch.save(pieces.where(F.col("length") < capacity), "todo")
    done, turn = [full], 0
    while True:
        n = group_count(todo.count(), group_size)

        def pack_group(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["length", "key"], ignore_index=True)
            where, fill = pack_lengths(group["length"].to_numpy(), capacity)
            keep = np.ones(len(fill), bool)
            if n > 1:
                order = np.argsort(fill, kind="stable")
                passed = np.bincount(where, minlength=len(fill))[order].cumsum()
                keep[order[(passed <= len(group) // PASS_ON) & (fill[order] < capacity)]] = False
            group["bin"], group["keep"] = where, keep[where]
            group["offset"] = group.groupby("bin")["length"].cumsum() - group["length"]
            return group[["key", "length", "grp", "bin", "keep", "offset"]]

        # Sorted pieces are dealt to the groups in turn; each partition starts at another group.
        dealt = todo.repartitionByRange("length", F.xxhash64("key"), "key")
        dealt = dealt.sortWithinPartitions("length", F.xxhash64("key"), "key")
        card = F.monotonically_increasing_id().bitwiseAND(2**33 - 1)
        dealt = dealt.withColumn("grp", F.pmod(card + F.hash(F.spark_partition_id()), F.lit(n)))
        packs = dealt.groupBy("grp").applyInPandas(
            pack_group,
            "key long, length long, grp long, bin long, keep boolean, offset long",
        )
        packs = scratch.save(packs, f"turn{turn}")
        number = F.shiftleft(F.shiftleft("grp", 16).bitwiseOR(F.col("bin")), 6).bitwiseOR(turn)
        done.append(
            packs.where("keep").select("key", number.alias("sequence_id"), "offset")
        )
        if n == 1:
            break
        todo, turn = packs.where("NOT keep").select("key", "length"), turn + 1
    result = done[0]
    for more in done[1:]:
        result = result.union(more)
    return result


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``with_ids`` adds the token ids. The texts are read once and are not shuffled; sorting and
    packing see a key and a length per piece.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = tokenize(docs, doc_id, text, capacity, path or default_path(), with_ids)
    pieces = scratch.save(pieces, "pieces").withColumn("key", F.monotonically_increasing_id())
    pieces = scratch.save(pieces, "keyed")
    scratch.drop("pieces")
    places = pack(pieces, "key", "length", capacity, scratch=scratch)
    columns = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return pieces.join(places, "key").select(
        F.col("id").alias(doc_id), *columns, "sequence_id", "offset"
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences of :func:`pack_documents` with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
