"""Exact Jaccard join of documents' word n-gram sets, by prefix lists and relations between sets.

A text's set is its distinct shingles of ``k`` words (fewer words are one shingle) as 64-bit hashes;
equal sets form a class. Two sets link when ``100 * intersection >= percent * union``. Tokens have a
global order, those of rarer hash buckets first (counted over all documents), and a set of size n
keeps the first ``n - ceil(percent * n / 100) + 1`` of them as its prefix: sets that link share a
token of both prefixes. The lists of prefix tokens are the index.

Relations between sets keep hot lists from being expanded into pairs:

* The leader of a list is the set there that stands in most lists: of a group of copies, one that
  was hardly edited. Every set is compared with the leader it meets most often;
  sets at least ``FAMILY`` percent similar to a leader form its family and are stored as differences
  from it: the tokens removed and the tokens added.
* Answers within a family are derived from the leader's: sets S and R share ``|B| - |Ds| - |Dr| +
  |Ds & Dr| + |As & Ar|`` tokens, so only differences meet, block by block.
* Lists of up to ``SMALL`` sets give pairs, those whose sizes and positions allow a link. A longer list
  holds one entry per family and size class, with its sizes and the most that can still be shared
  from that position on, and is cut into blocks by size class and position; a pair of blocks is
  skipped if its sizes or positions exclude a link.
  Leaders of families that remain are compared, first by parity vectors, which bound how much two
  sets differ, then exactly. By the triangle inequality of Jaccard distance most pairs of families
  are settled by that; the members of the others are compared.

Blocks report each set's number of links and one edge per set to the least of its component there, so
a group of copies never becomes all of its pairs. No list, block or candidate is capped.

Null and blank texts have no shingles and are linked with nothing. Each row is a document of its own,
also if it repeats an id or another row; a component without any id has none. An empty table gives an
empty result. Texts are read whole. Results have fixed columns, so further columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from textprep.llm.common import Scratch, quoted, row_key, sliced, small_batches, texts_of
from textprep.llm.components import components
from textprep.llm.shingles import shingle_hashes, word_hashes

WORDS = 5
PERCENT = 80
#: Sets at least so similar to their leader, in percent, are stored as differences from it.
FAMILY = 50
#: Hash buckets of the token counts; a bucket counts as frequent from ``FREQUENT`` times the mean.
BUCKETS, FREQUENT = 1 << 20, 4
#: Lists of up to so many sets give pairs as rows; longer ones are cut into blocks of that size.
SMALL = 64
#: Members and tokens of a block of a family.
BLOCK, BLOCK_TOKENS = 1024, 400_000
#: Columns of the 0/1 matrices that are multiplied at once.
COLUMNS = 1024


def token_set(text: bytes, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), k))


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def frequent_buckets(docs: DataFrame, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of tokens that stand out, and how far: at most ``BUCKETS / FREQUENT`` of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in sliced(batches, 500):
            sets = [token_set(t, k) for t in texts_of(batch.column(0))]
            counts += np.bincount(bucket_of(np.concatenate(sets)), minlength=BUCKETS)
        found = np.flatnonzero(counts)
        for start in range(0, len(found), 50_000):
            part = found[start : start + 50_000]
            arrays = [pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "n"])

    counts = docs.select(quoted(text)).mapInArrow(rows, "bucket long, n long")
    scratch = Scratch(docs.sparkSession, "buckets")
    counts = scratch.save(counts.groupBy("bucket").agg(F.sum("n").alias("n")), "counts", BUCKETS)
    total = counts.agg(F.sum("n")).first()[0] or 0
    mean = max(1.0, total / BUCKETS)
    level = F.floor(F.log2(F.col("n") / mean)).alias("level")
    found = counts.where(F.col("n") >= FREQUENT * mean).select("bucket", level).collect()
    scratch.close()
    buckets, levels = zip(*found) if found else ((), ())
    return np.array(buckets, np.int64), np.array(levels, np.uint8)


def set_rows(
    docs: DataFrame, doc_id: str, text: str, k: int, percent: int, frequent: tuple
) -> DataFrame:
    """``k1, k2, id, n, g1, g2, prefix``: set size, 128-bit digest of the set, and its prefix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.zeros(BUCKETS, np.uint8)
        levels[frequent[0]] = frequent[1]
        for batch in sliced(batches, 500):
            n, g1, g2, prefixes = [], [], [], []
            for t in texts_of(batch.column(3)):
                found = token_set(t, k)
                digest = xxhash.xxh3_128_intdigest(found)
                n.append(len(found))
                g1.append((digest >> 64) - 2**63)
                g2.append((digest & (2**64 - 1)) - 2**63)
                first = len(found) - (percent * len(found) + 99) // 100 + 1
                order = np.lexsort((found, levels[bucket_of(found)]))[:first]
                prefixes.append(found[order].view(np.int64))
            arrays = [pa.array(c, pa.int64()) for c in (n, g1, g2)]
            arrays.append(pa.array(prefixes, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(batch.columns[:3] + arrays, names)

    names = ["k1", "k2", "id", "n", "g1", "g2", "prefix"]
    k1, k2 = row_key(doc_id, text)
    source = docs.select(k1, k2, F.col(quoted(doc_id)).cast("long").alias("id"), quoted(text))
    return source.mapInArrow(
        rows, "k1 long, k2 long, id long, n long, g1 long, g2 long, prefix array<long>"
    )


def parity(tokens: np.ndarray) -> bytes:
    """A bit per hash bucket, set if it holds an odd number of tokens; as many bits as tokens or more."""
    size = 1 << max(6, (len(tokens) - 1).bit_length())
    bucket = (tokens >> np.uint64(8)).astype(np.int64) & (size - 1)
    return np.packbits(np.bincount(bucket, minlength=size) & 1).tobytes()


def least_apart(one: bytes, two: bytes) -> int:
    """A lower bound on the tokens that only one of two sets holds: bits in which they differ.

    The longer vector is folded first, which merges buckets and keeps their parity.
    """
    a, b = sorted((np.frombuffer(x, np.uint8) for x in (one, two)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """``node, size, tokens`` (sorted 64-bit hashes), ``parity`` from ``node, text``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            sets = [token_set(t, k) for t in texts_of(batch.column(1))]
            blobs = [[s.tobytes() for s in sets], [parity(s) for s in sets]]
            arrays = [batch.column(0), pa.array([len(s) for s in sets], pa.int64())]
            arrays += [pa.array(b, pa.binary()) for b in blobs]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "size", "tokens", "parity"])

    return texts.mapInArrow(rows, "node long, size long, tokens binary, parity binary")


def with_bound(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (``u, v`` and more numbers) with ``bound``: no less than their Jaccard similarity."""
    names = [c for c in pairs.columns if c not in ("u", "v")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            sides = [batch.column(c).to_pylist() for c in ("nu", "nv", "one", "two")]
            bounds = []
            for nu, nv, one, two in zip(*sides):
                apart = least_apart(one, two)
                bounds.append((nu + nv - apart) / (nu + nv + apart))
            kept = [batch.column(c) for c in ("u", "v", *names)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bounds, pa.float64())], ["u", "v", *names, "bound"])

    for side, blob in (("u", "one"), ("v", "two")):
        of = sets.select(F.col("node").alias(side), F.col("parity").alias(blob), F.col("size").alias(f"n{side}"))
        pairs = pairs.join(of, side)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select("u", "v", *names).schema)
    return pairs.select("u", "v", *names, "nu", "nv", "one", "two").mapInArrow(rows, f"{kinds}, bound double")


def compared(pairs: DataFrame, sets: DataFrame, family: int) -> DataFrame:
    """Pairs ``u, v`` with set sizes and what they share; the differences of v where it is near u."""
    kinds = [pa.int64()] * 5 + [pa.binary()] * 2
    names = ["u", "v", "nu", "nv", "common", "removed", "added"]

    def compare(u: bytes, v: bytes) -> tuple:
        one, two = np.frombuffer(u, "<u8"), np.frombuffer(v, "<u8")
        place = np.minimum(np.searchsorted(two, one), len(two) - 1)
        hit = two[place] == one
        common = int(hit.sum())
        if 100 * common < family * (len(one) + len(two) - common):
            return len(one), len(two), common, None, None
        new = np.ones(len(two), bool)
        new[place[hit]] = False
        return len(one), len(two), common, np.packbits(~hit).tobytes(), two[new].tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            u, v = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = [compare(*pair) for pair in zip(u, v)]
            columns = [batch.column(0), batch.column(1)]
            columns += [pa.array([x[i] for x in out], kinds[i + 2]) for i in range(5)]
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = pairs.select("u", "v").join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("one")), "u")
    joined = joined.join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("two")), "v")
    return joined.select("u", "v", "one", "two").mapInArrow(
        rows, "u long, v long, nu long, nv long, common long, removed binary, added binary"
    )


def sets_of(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The sets of ``pairs`` only: both sides of the comparison then exchange just these."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    return scratch.save(sets.select("node", "tokens").join(wanted.hint("merge"), "node", "left_semi"), name)


def least_shared(one: Column, two: Column, percent: int) -> Column:
    """How many tokens sets of these sizes share at least if they link."""
    return F.ceil(percent * (one + two) / F.lit(100.0 + percent) - 1e-9)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes (``lo`` to ``hi``) and what is left from a position (``left``) allow a link."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    sizes = (100 * y("hi") >= percent * x("lo")) & (100 * x("hi") >= percent * y("lo"))
    return sizes & (F.least(x("left"), y("left")) >= least_shared(x("lo"), y("lo"), percent))


def pairs_in_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Candidate families ``u, v`` from the pairs of blocks of one list that may link."""

    def side(entries: list[dict]) -> dict[str, np.ndarray]:
        return {c: np.array([e[c] for e in entries]) for c in ("family", "lo", "hi", "left")}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            found: set[tuple[int, int]] = set()
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = side(one), side(two)
                x = {c: v[:, None] for c, v in x.items()}
                keep = (100 * y["hi"] >= percent * x["lo"]) & (100 * x["hi"] >= percent * y["lo"])
                shared = -(-percent * (x["lo"] + y["lo"]) // (100 + percent))
                keep &= (np.minimum(x["left"], y["left"]) >= shared) & (x["family"] != y["family"])
                for i, j in np.argwhere(keep):
                    u, v = int(x["family"][i, 0]), int(y["family"][j])
                    found.add((min(u, v), max(u, v)))
            out = sorted(found)
            arrays = [pa.array([p[i] for p in out], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(arrays, ["u", "v"])

    one, two = blocks.alias("a"), blocks.alias("b")
    order = F.struct("a.size", "a.place", "a.salt") <= F.struct("b.size", "b.place", "b.salt")
    near = F.abs(F.col("a.size") - F.col("b.size")) <= 1
    met = one.join(two, F.expr("a.token = b.token") & order & near & may_link("a", "b", percent))
    met = met.select(F.col("a.entries").alias("one"), F.col("b.entries").alias("two"))
    return met.mapInArrow(rows, "u long, v long").distinct()


def small_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets ``u < v`` that meet in a list of up to ``SMALL`` entries and may link."""
    small = entries.where(F.col("rows") <= SMALL).select(
        "token", "node", F.col("n").alias("lo"), F.col("n").alias("hi"), F.expr("n - pos").alias("left")
    )
    one, two = small.alias("a"), small.alias("b")
    met = one.join(two, F.expr("a.token = b.token AND a.node < b.node") & may_link("a", "b", percent))
    return met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def large_pairs(entries: DataFrame, percent: int, total: int, scratch: Scratch) -> DataFrame:
    """Pairs of families that meet in a longer list and hold sets that may link.

    ``entries``, ``total`` at most: ``token, family, size`` (class), ``lo``, ``hi`` (set sizes), ``left``.
    """
    mixed = entries.groupBy("token").agg(F.min("family").alias("low"), F.max("family").alias("high"))
    mixed = scratch.save(mixed.where("low < high").select("token"), "mixed", total)
    # The position within the prefix, in tenths of it.
    place = F.floor(F.col("hi") - F.col("left")) * 1000 / (F.col("hi") * (100 - percent) + 1)
    entries = entries.join(mixed, "token").withColumn("place", F.floor(place).cast("int"))
    entries = scratch.save(entries, "placed", total)
    counts = entries.groupBy("token", "size", "place").agg(F.count(F.lit(1)).alias("members"))
    counts = scratch.save(counts, "sizes", total)
    salt = F.pmod(F.xxhash64("family"), F.expr(f"members div {SMALL} + 1"))
    blocks = entries.join(counts, ["token", "size", "place"]).groupBy(
        "token", "size", "place", salt.alias("salt")
    )
    blocks = blocks.agg(
        F.collect_list(F.struct("family", "lo", "hi", "left")).alias("entries"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("left").alias("left"),
    )
    return pairs_in_blocks(scratch.save(blocks, "blocks", total), percent)


def overlaps(one: list[np.ndarray], two: list[np.ndarray], same: bool) -> np.ndarray:
    """The size of each intersection of a set of ``one`` with a set of ``two``, as exact floats."""
    common = np.zeros((len(one), len(two)), np.float32)
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two)]
    empty = np.zeros(0, np.uint64)
    tokens = [np.concatenate([empty, *x]) for x in (one, two)]
    if same:
        distinct, counts = np.unique(tokens[0], return_counts=True)
        shared = distinct[counts > 1]
    else:
        shared = np.intersect1d(*tokens)
    if not len(shared):
        return common
    held = []
    for t, o in zip(tokens, owners):
        place = np.minimum(np.searchsorted(shared, t), len(shared) - 1)
        hit = shared[place] == t
        order = np.argsort(place[hit], kind="stable")
        held.append((place[hit][order], o[hit][order]))
    for start in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - start)
        parts = []
        for (place, owner), n in zip(held, (len(one), len(two))):
            a, b = np.searchsorted(place, [start, start + width])
            part = np.zeros((n, width), np.float32)
            part[owner[a:b], place[a:b] - start] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    return common


def linked_blocks(work: DataFrame, percent: int) -> DataFrame:
    """``node, root, links`` from pairs of blocks: to the least node of its component there, how many.

    ``work``: ``same`` (a block with itself), ``kin`` (blocks of one family), ``base1, members1,
    base2, members2``. A set's links count the documents of the other class.
    """

    def bits(base: np.ndarray, member: dict) -> np.ndarray:
        if member["removed"] is None:
            return np.zeros(len(base), bool)
        return np.unpackbits(np.frombuffer(member["removed"], np.uint8), count=len(base)).view(bool)

    def added(member: dict) -> np.ndarray:
        return np.frombuffer(member["added"] or b"", "<u8")

    def shared(base1: bytes, one: list[dict], base2: bytes, two: list[dict], same: bool, kin: bool):
        bases = [np.frombuffer(b, "<u8") for b in (base1, base2)]
        if not kin:
            sets = [
                [np.concatenate([base[~bits(base, m)], added(m)]) for m in side]
                for base, side in zip(bases, (one, two))
            ]
            return overlaps(*sets, same=False)
        base = bases[0]
        gone = [[base[bits(base, m)] for m in side] for side in (one, two)]
        new = [[added(m) for m in side] for side in (one, two)]
        lost = [np.array([len(g) for g in side], np.float32) for side in gone]
        both = overlaps(*gone, same=same) + overlaps(*new, same=same)
        return len(base) - lost[0][:, None] - lost[1][None, :] + both

    def links(same: bool, kin: bool, base1: bytes, one: list, base2: bytes, two: list) -> list[tuple]:
        common = shared(base1, one, base2, two, same, kin)
        sizes = [np.array([m["n"] for m in side]) for side in (one, two)]
        union = sizes[0][:, None] + sizes[1][None, :] - common
        link = 100 * common >= percent * union
        if same:
            np.fill_diagonal(link, False)
        ids = [np.array([m["node"] for m in side]) for side in (one, two)]
        weights = [np.array([m["copies"] for m in side]) for side in (one, two)]
        counts = [link @ weights[1], weights[0] @ link]
        # The least node of each component, spread until nothing changes.
        labels = [ids[0].copy(), ids[1].copy()]
        most = np.iinfo(np.int64).max
        while True:
            low = np.minimum(labels[1], np.where(link, labels[0][:, None], most).min(axis=0))
            high = np.minimum(labels[0], np.where(link, low[None, :], most).min(axis=1))
            if (low == labels[1]).all() and (high == labels[0]).all():
                break
            labels = [high, low]
        out = []
        for side in range(1 if same else 2):
            for i in np.flatnonzero(counts[side]):
                out.append((int(ids[side][i]), int(labels[side][i]), int(counts[side][i])))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 8):
            columns = [batch.column(i).to_pylist() for i in range(6)]
            out = [x for row in zip(*columns) for x in links(*row)]
            arrays = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "root", "links"])

    columns = "same", "kin", "base1", "members1", "base2", "members2"
    return work.select(*columns).mapInArrow(rows, "node long, root long, links long")


def families(stars: DataFrame, nodes: DataFrame, kept: int, scratch: Scratch) -> DataFrame:
    """``node, n, copies, family, removed, added, far``: each node's leader and distance from it.

    A leader has no leader of its own; of several the most similar one is taken, then the least.
    """
    near = stars.where("removed IS NOT NULL")
    led = near.select(F.col("v").alias("u")).distinct()
    near = near.join(scratch.save(led, "led", kept), "u", "left_anti")
    like = F.col("common") / (F.col("nu") + F.col("nv") - F.col("common"))
    chosen = near.groupBy("v").agg(
        F.max_by(
            F.struct("u", "removed", "added", (1 - like).alias("far")), F.struct(like, -F.col("u"))
        ).alias("lead")
    )
    chosen = chosen.select(F.col("v").alias("node"), "lead.*")
    placed = nodes.join(chosen, "node", "left")
    return placed.select(
        "node", "n", "copies", F.coalesce("u", "node").alias("family"), "removed", "added",
        F.coalesce("far", F.lit(0.0)).alias("far"),
    )


def jaccard_links(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    k: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``: one row per document.

    ``component_id`` is the least id reachable by links, ``n_links`` the number of documents linked.
    """
    scratch = Scratch(docs.sparkSession, "setjoin")
    frequent = frequent_buckets(docs, text, k)
    rows = scratch.save(set_rows(docs, doc_id, text, k, percent, frequent), "rows")

    # One class per distinct set; its least row stands for it.
    classes = rows.where("n > 0").groupBy("g1", "g2").agg(
        F.min("id").alias("least"), F.min(F.struct("k1", "k2")).alias("row"),
        F.first("n").alias("n"), F.first("prefix").alias("prefix"),
        F.count(F.lit(1)).alias("copies"),
    )
    classes = classes.withColumn("node", F.monotonically_increasing_id())
    classes = classes.select("node", "g1", "g2", "least", "row.*", "n", "copies", "prefix")
    classes = scratch.save(classes, "classes", 4 * rows.count())
    rows = scratch.save(rows.select("id", "n", "g1", "g2"), "documents", rows.count())
    scratch.drop("rows")
    entries = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    total = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    lists = scratch.save(lists, "tokens", total)
    entries = scratch.save(entries.join(lists, "token"), "entries", total)
    scratch.drop("tokens")
    scratch.free_shuffles()
    total, kept = entries.count(), classes.count()
    classes = scratch.save(classes.drop("prefix"), "slim", kept)
    scratch.drop("classes")

    # Sets that may link with any other; the texts of the rest are not read again.
    close = scratch.save(small_pairs(entries, percent), "close", total)
    scratch.free_shuffles()
    needed = close.select(F.col("u").alias("node")).union(close.select("v"))
    needed = needed.union(entries.where(F.col("rows") > SMALL).select("node")).distinct()
    nodes = classes.select("node", "k1", "k2", "n", "copies").join(needed, "node")
    nodes = scratch.save(nodes, "nodes", kept)
    k1, k2 = row_key(doc_id, text)
    texts = docs.select(k1, k2, F.col(quoted(text)).alias("text"))
    texts = texts.join(nodes.select("node", "k1", "k2").hint("merge"), ["k1", "k2"])
    with small_batches(docs.sparkSession):
        sets = scratch.save(full_sets(texts.select("node", "text"), k), "sets")
        if sets.count() > nodes.count():  # rows of one id and text
            sets = scratch.save(sets.dropDuplicates(["node"]), "distinct")
        scratch.free_shuffles()

        # Families around leaders: of those that may link with a node, the one it meets most often.
        degrees = entries.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        met = entries.join(scratch.save(degrees, "degrees", kept), "node")
        met = scratch.save(met.withColumn("turn", -F.col("node")), "met", total)
        first = F.max(F.struct("degree", "turn", F.col("n").alias("m"), F.col("pos").alias("at")))
        leaders = scratch.save(met.groupBy("token").agg(first.alias("first")), "firsts", total)
        ahead = met.join(leaders, "token").where("turn <> first.turn").select(
            (-F.col("first.turn")).alias("u"), F.col("node").alias("v"),
            F.struct(F.col("n").alias("lo"), F.col("n").alias("hi"), F.expr("n - pos").alias("left")).alias("b"),
            F.struct(
                F.col("first.m").alias("lo"), F.col("first.m").alias("hi"), F.expr("first.m - first.at").alias("left")
            ).alias("a"),
        )
        ahead = ahead.where(may_link("a", "b", percent)).groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"))
        stars = ahead.groupBy("v").agg(F.max(F.struct("c", (-F.col("u")).alias("u"))).alias("best"))
        stars = scratch.save(stars.select((-F.col("best.u")).alias("u"), "v"), "leaders", kept)
        stars = with_bound(stars, sets).where(F.col("bound") >= FAMILY / 100)
        stars = scratch.save(stars.select("u", "v"), "near", kept)
        scratch.free_shuffles()
        stars = scratch.save(compared(stars, sets_of(stars, sets, scratch, "sets_led"), FAMILY), "stars", 4 * kept)
        scratch.drop("met", "firsts", "degrees", "leaders", "near", "sets_led")
        scratch.free_shuffles()
        placed = families(stars, nodes.select("node", "n", "copies"), kept, scratch)
        placed = scratch.save(placed, "families", 4 * kept)
        sizes = placed.groupBy("family").agg(
            F.count(F.lit(1)).alias("members"), F.max("far").alias("far")
        )
        sizes = scratch.save(sizes, "sized", kept)

        # Families with sets that may link, and what their leaders say about them.
        step = math.log(100 / percent) if percent < 100 else 1.0
        size_class = F.floor(F.log(F.col("n")) / step + 1e-9).cast("int")
        belongs = placed.select("node", "family")
        listed = entries.where(F.col("rows") > SMALL).join(belongs, "node")
        listed = listed.groupBy("token", "family", size_class.alias("size")).agg(
            F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.expr("n - pos")).alias("left")
        )
        pairs = close
        for c in "uv":
            to = belongs.select(F.col("node").alias(c), F.col("family").alias(f"family_{c}"))
            pairs = pairs.join(to, c)
        pairs = pairs.where("family_u <> family_v").select(
            F.least("family_u", "family_v").alias("u"), F.greatest("family_u", "family_v").alias("v")
        )
        pairs = pairs.union(large_pairs(listed, percent, total, scratch)).distinct()
        for c in "uv":
            of = sizes.select(
                F.col("family").alias(c), F.col("members").alias(f"members_{c}"), F.col("far").alias(f"far_{c}")
            )
            pairs = pairs.join(of, c)
        # Leaders farther apart than this have no members that link.
        reach = F.lit(1 - percent / 100 + 1e-9) + F.col("far_u") + F.col("far_v")
        both = F.expr("members_u = 1 AND members_v = 1")
        pairs = scratch.save(pairs.select("u", "v", reach.alias("reach"), both.alias("both")), "pairs")
        pairs = with_bound(pairs, sets).where("1 - bound <= reach")
        pairs = scratch.save(pairs.select("u", "v", "reach", "both"), "plausible")
        met = pairs.count()
        scratch.free_shuffles()
        asked = sets_of(pairs, sets, scratch, "asked_sets")
        bases = compared(pairs, asked, 101).drop("removed", "added").join(pairs, ["u", "v"])
        bases = scratch.save(bases, "bases", 4 * met)
        scratch.drop("close", "pairs", "placed", "blocks", "mixed", "sizes", "asked_sets")
        scratch.free_shuffles()
        union = F.col("nu") + F.col("nv") - F.col("common")
        distance = 1 - F.col("common") / union
        alone = bases.where(F.col("both") & (100 * F.col("common") >= percent * union)).select("u", "v")
        wide = bases.where(~F.col("both") & (distance <= F.col("reach"))).select("u", "v")
        wide = scratch.save(wide, "wide", met)

        # Members in blocks of one family and size class.
        asked = sizes.where("members > 1").select("family")
        asked = asked.union(wide.select("u")).union(wide.select("v")).distinct()
        asked = scratch.save(asked, "asked", kept)
        grouped = placed.withColumn("size", size_class).join(asked, "family")
        counts = grouped.groupBy("family", "size").agg(
            F.count(F.lit(1)).alias("count"), F.max("n").alias("longest")
        )
        grouped = grouped.join(scratch.save(counts, "counts", kept), ["family", "size"])
        room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"{BLOCK_TOKENS} div longest")))
        salt = F.pmod(F.xxhash64("node"), F.floor(F.col("count") / room) + 1)
        blocks = grouped.groupBy("family", "size", salt.alias("salt")).agg(
            F.collect_list(F.struct("node", "n", "copies", "removed", "added")).alias("members")
        )
        blocks = blocks.withColumn("block", F.monotonically_increasing_id())
        blocks = scratch.save(blocks, "members", 4 * kept)
        names = blocks.select("family", "size", "block")
        one, two = names.alias("a"), names.alias("b")
        near = F.abs(F.col("a.size") - F.col("b.size")) <= 1
        kin = one.join(two, F.expr("a.family = b.family AND a.block <= b.block") & near)
        several = sizes.where("members > 1").select(F.col("family").alias("f"))
        kin = kin.join(several, F.col("a.family") == F.col("f"))
        kin = kin.select(F.col("a.block").alias("b1"), F.col("b.block").alias("b2"), F.lit(True).alias("kin"))
        apart = wide.join(one, F.expr("u = a.family")).join(two, F.expr("v = b.family") & near)
        apart = apart.select(
            F.col("a.block").alias("b1"), F.col("b.block").alias("b2"), F.lit(False).alias("kin")
        )
        work = scratch.save(kin.union(apart), "work", kept + met)
        leading = sets.select("node", "tokens").join(asked.select(F.col("family").alias("node")), "node", "left_semi")
        based = blocks.join(scratch.save(leading, "leading"), F.col("family") == F.col("node"))
        based = scratch.save(based.select("block", "tokens", "members"), "based", 8 * kept)
        for i in "12":
            side = based.select(
                F.col("block").alias(f"b{i}"), F.col("tokens").alias(f"base{i}"), F.col("members").alias(f"members{i}")
            )
            work = work.join(side, f"b{i}")
        work = work.withColumn("same", F.col("b1") == F.col("b2"))
        found = scratch.save(linked_blocks(work, percent), "found")

    weights = nodes.select("node", "copies")
    ways = alone.select(F.col("u").alias("node"), F.col("v").alias("other"))
    ways = ways.union(ways.select("other", "node"))
    ways = ways.join(weights.withColumnRenamed("node", "other"), "other")
    counted = ways.select("node", F.col("copies").alias("links")).union(found.select("node", "links"))
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"))
    edges = alone.union(found.where("node <> root").select("node", "root"))
    placed = components(scratch.save(edges, "edges", 2 * (kept + met)), scratch, "linked")

    members = classes.select("g1", "g2", "node", "copies", "least")
    members = members.join(counted, "node", "left").join(placed, "node", "left")
    members = scratch.save(members.withColumn("c", F.coalesce("component", "node")), "joined", kept)
    roots = members.groupBy("c").agg(F.min("least").alias("component_id"))
    links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    members = members.join(scratch.save(roots, "roots", kept), "c").select("g1", "g2", "component_id", links)
    members = scratch.save(members, "answers", kept)
    scratch.drop("sets", "distinct", "stars", "entries", "members", "based", "families")
    placed = rows.select("id", "n", "g1", "g2").join(members, ["g1", "g2"], "left")
    return placed.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
