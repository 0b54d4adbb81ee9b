"""Near-duplicate documents by MinHash, exact confirmation and connected components.

A text's set is its distinct shingles of ``k`` words (fewer words are one shingle), as 64-bit hashes.
Documents with equal sets form a class, and only one text per class goes on. ``BANDS * ROWS`` hash
minima per set are cut into bands; sets that share a band are candidates. A pair is checked on its
signatures first and then confirmed on the full sets: linked if ``100 * intersection >= percent *
union``. Links make components.

Pairs within a band's bucket grow with its square, so not all of them are made. First each member
is compared with the least member only, and components are formed. What is left are pairs of
different components in one bucket. Small buckets (``SMALL``) give these pairs as rows. The members
of larger ones are put in blocks, and blocks are compared with each other inside tasks, exactly, by
products of their shingle matrices. So every two sets that share a band are in one component by
confirmed links, or have been compared.

Null and blank texts have no shingles and are linked with nothing. Rows with equal ids are documents
of their own. An empty table gives an empty result. Further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from textprep.llm.common import (
    Scratch, mixed64, packed, quoted, row_key, sliced, small_batches, texts_of, unpacked,
)
from textprep.llm.components import components
from textprep.llm.shingles import shingle_hashes, word_hashes

WORDS = 5
PERCENT = 80
# A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 6) ** 40 = 5e-6.
BANDS, ROWS = 40, 6
#: Five standard deviations of the signature's estimate at the threshold.
SIGNATURE_SLACK = 5.0
SEED = 9
#: Buckets of up to so many sets give pairs as rows; the members of others are put in blocks.
SMALL, BLOCK = 24, 64


def permutations(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the universal hashes x -> a * x + b modulo 2^32."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**32, (2, BANDS * ROWS), dtype=np.uint32)
    return a | np.uint32(1), b


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (mixed64(shingles) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 2**32 - 1, np.uint32)
    for start in range(0, len(x), 2048):
        hashed = np.multiply.outer(a, x[start : start + 2048])
        hashed += b[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mixed64(key * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, j])
    return key.view(np.int64)


def text_sets(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """``k1, k2, id, n, g1, g2, bands``: set size, 128-bit digest of the set, and its bands."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations()
        for batch in sliced(batches, 500):
            n, g1, g2, bands = [], [], [], []
            for t in texts_of(batch.column(3)):
                found = np.unique(shingle_hashes(word_hashes(t), k))
                digest = xxhash.xxh3_128_intdigest(found)
                n.append(len(found))
                g1.append((digest >> 64) - 2**63)
                g2.append((digest & (2**64 - 1)) - 2**63)
                bands.append(band_keys(signature(found, a, b)) if len(found) else [])
            arrays = [pa.array(c, pa.int64()) for c in (n, g1, g2)]
            arrays.append(pa.array(bands, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(batch.columns[:3] + arrays, names)

    names = ["k1", "k2", "id", "n", "g1", "g2", "bands"]
    k1, k2 = row_key(doc_id, text)
    source = docs.select(k1, k2, F.col(quoted(doc_id)).cast("long").alias("id"), quoted(text))
    return source.mapInArrow(
        rows, "k1 long, k2 long, id long, n long, g1 long, g2 long, bands array<long>"
    )


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """``node, sig, shingles`` (32-bit minima and sorted 64-bit hashes) from ``node, text``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations()
        for batch in sliced(batches, 500):
            sets = [np.unique(shingle_hashes(word_hashes(t), k)) for t in texts_of(batch.column(1))]
            sigs = pa.array([signature(s, a, b).tobytes() for s in sets], pa.binary())
            blobs = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sigs, blobs], ["node", "sig", "shingles"]
            )

    return texts.mapInArrow(rows, "node long, sig binary, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` that are similar: by signature, then on the full sets."""
    least = percent / 100
    slack = SIGNATURE_SLACK * (least * (1 - least) / (BANDS * ROWS)) ** 0.5

    def similar(sig_u: bytes, sig_v: bytes, set_u: bytes, set_v: bytes) -> bool:
        agree = np.frombuffer(sig_u, "<u4") == np.frombuffer(sig_v, "<u4")
        small, large = sorted((len(set_u) // 8, len(set_v) // 8))
        if agree.mean() < least - slack or 100 * small < percent * large:
            return False
        u, v = np.frombuffer(set_u, "<u8"), np.frombuffer(set_v, "<u8")
        common = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
        return 100 * common >= percent * (len(u) + len(v) - common)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            keep = pa.array([similar(*row) for row in zip(*columns)], pa.bool_())
            yield batch.select(["u", "v"]).filter(keep)

    def side(name: str) -> DataFrame:
        return sets.select(*[F.col(c).alias(f"{c}_{name}") for c in sets.columns])

    joined = pairs.join(side("u"), F.col("u") == F.col("node_u"))
    joined = joined.join(side("v"), F.col("v") == F.col("node_v"))
    columns = "u", "v", "sig_u", "sig_v", "shingles_u", "shingles_v"
    return joined.select(*columns).mapInArrow(rows, "u long, v long")


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` between sets of different components, from pairs of blocks of one bucket.

    Only shingles that both blocks hold become columns of the 0/1 matrices, whose product is the
    size of every intersection.
    """

    def held(shared: np.ndarray, sizes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
        """Which set holds which of the shared shingles, as 0/1."""
        place = np.searchsorted(shared, shingles)
        place[place == len(shared)] = 0
        hit = shared[place] == shingles
        found = np.zeros((len(sizes), len(shared)), np.float32)
        found[np.repeat(np.arange(len(sizes)), sizes)[hit], place[hit]] = 1
        return found

    def links(one: list[dict], two: list[dict]) -> list[tuple[int, int]]:
        comps = [np.array([x["comp"] for x in side]) for side in (one, two)]
        differ = comps[0][:, None] != comps[1][None, :]
        if not differ.any():
            return []
        ids = [np.array([x["node"] for x in side]) for side in (one, two)]
        sizes = [np.array([len(x["shingles"]) // 8 for x in side]) for side in (one, two)]
        joined = [
            np.frombuffer(b"".join(x["shingles"] for x in side), "<u8") for side in (one, two)
        ]
        shared = np.intersect1d(*joined)
        if not len(shared):
            return []
        common = held(shared, sizes[0], joined[0]) @ held(shared, sizes[1], joined[1]).T
        union = sizes[0][:, None] + sizes[1][None, :] - common
        linked = (100 * common >= percent * union) & differ
        return [(int(ids[0][i]), int(ids[1][j])) for i, j in np.argwhere(linked)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 16):
            pairs = zip(*[batch.column(i).to_pylist() for i in range(2)])
            out = sorted({link for one, two in pairs for link in links(one, two)})
            arrays = [pa.array([x[i] for x in out], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(arrays, ["u", "v"])

    one = blocks.select("key", F.col("block").alias("b1"), F.col("members").alias("one"))
    two = blocks.select("key", F.col("block").alias("b2"), F.col("members").alias("two"))
    joined = one.join(two, "key").where("b1 <= b2").select("one", "two")
    return joined.mapInArrow(rows, "u long, v long")


def marked_rows(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """``m1, m2`` (the row's key), ``n_shingles``, ``component`` (a number, null without shingles), ``component_id``."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.save(text_sets(docs, doc_id, text, k), "rows")

    # One class per distinct set, numbered; its least row stands for it.
    total = rows.count()
    first = F.min(F.struct("k1", "k2")).alias("row")
    classes = rows.where("n > 0").groupBy("g1", "g2").agg(F.min("id").alias("id"), first)
    classes = classes.select("g1", "g2", "id", "row.*")
    classes = classes.withColumn("node", F.monotonically_increasing_id())
    classes = scratch.save(classes, "classes", total)
    firsts = classes.select("k1", "k2", "g1", "g2", "node")
    keys = rows.where("n > 0").join(firsts, ["k1", "k2", "g1", "g2"])
    keys = keys.select("node", F.explode("bands").alias("key")).distinct()
    leaders = keys.groupBy("key").agg(
        F.min("node").alias("leader"), F.count(F.lit(1)).alias("members")
    )
    leaders = leaders.where("members > 1")
    buckets = scratch.save(keys.join(leaders, "key"), "buckets", BANDS * total)

    # Sets of all candidates; the shuffle of texts is the only one.
    needed = firsts.join(buckets.select("node").distinct(), "node").select("node", "k1", "k2")
    needed = scratch.save(needed, "needed", total)
    k1, k2 = row_key(doc_id, text)
    texts = docs.select(k1, k2, F.col(quoted(text)).alias("text")).join(needed.hint("merge"), ["k1", "k2"])
    sets = full_sets(texts.select("node", "text"), k).dropDuplicates(["node"])
    with small_batches(docs.sparkSession):
        links = links_of(buckets, sets, percent, total, scratch)
    scratch.drop("blocks", "sets")
    found = scratch.save(components(links, scratch, "last"), "final", total)

    members = classes.select("g1", "g2", "node", F.col("id").alias("least"))
    members = members.join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
    roots = members.groupBy("c").agg(F.min("least").alias("component_id"))
    members = members.join(roots, "c").select("g1", "g2", "component_id", F.col("c").alias("component"))
    members = scratch.save(members, "members", total)
    marked = rows.select("k1", "k2", "id", "n", "g1", "g2").distinct()
    return marked.join(members, ["g1", "g2"], "left").select(
        F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col("n").alias("n_shingles"), "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def links_of(
    buckets: DataFrame, sets: DataFrame, percent: int, total: int, scratch: Scratch
) -> DataFrame:
    """``u, v``: links that make the components of all confirmed ones."""
    sets = scratch.save(sets, "sets")
    known = buckets.count()

    pairs = buckets.where("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v"))
    pairs = scratch.save(pairs.distinct(), "pairs", known)
    links = scratch.save(confirmed(pairs, sets, percent), "links", 4 * known)
    found = scratch.save(components(links, scratch, "first"), "found", total)

    # Buckets that still hold different components.
    placed = buckets.join(found.withColumnRenamed("component", "comp"), "node", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = mixed.where("low < high").select("key")
    placed = scratch.save(placed.join(mixed, "key"), "mixed", known)
    small = placed.where(F.col("members") <= SMALL)
    one = small.select("key", F.col("node").alias("u"), F.col("comp").alias("c"))
    two = small.select("key", F.col("node").alias("v"), F.col("comp").alias("d"))
    rest = one.join(two, "key").where("u < v AND c <> d").select("u", "v").distinct()
    rest = scratch.save(rest.join(pairs, ["u", "v"], "left_anti"), "rest")
    more = scratch.save(confirmed(rest, sets, percent), "more")
    large = placed.where(F.col("members") > SMALL).join(sets.drop("sig"), "node")
    block = F.pmod(F.xxhash64("node"), F.expr(f"members div {BLOCK} + 1"))
    blocks = large.groupBy("key", block.alias("block")).agg(
        F.collect_list(F.struct("node", "comp", "shingles")).alias("members")
    )
    blocks = scratch.save(blocks, "blocks", known)
    crossed = scratch.save(block_links(blocks, percent), "crossed")
    stars = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return stars.union(more).union(crossed)


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    k: int = WORDS,
    percent: int = PERCENT,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``docs``, or the named columns of it, with ``n_shingles``, ``component_id`` (least id of the component) and ``kept``.

    ``kept`` marks the rows with the least id of their component. What is exchanged: per row a
    digest and ``BANDS`` keys; texts once, of which only candidates' sets are kept; and sets for
    the candidate pairs.
    """
    k1, k2 = row_key(doc_id, text)
    marked = marked_rows(docs, doc_id, text, k, percent)
    joined = packed(docs, columns, k1=k1, k2=k2).join(marked, F.expr("k1 = m1 AND k2 = m2"))
    component = F.col("component_id")
    return unpacked(
        joined,
        columns or docs.columns,
        n_shingles=F.col("n_shingles"),
        component_id=component,
        kept=F.col(f"doc.{quoted(doc_id)}").cast("long").eqNullSafe(component),
    )


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``docs`` with one row of each component: the least id (nulls last), then the least row hash.

    So rows that repeat an id or another row stay once. Null and blank texts are linked with nothing
    and all stay. A task sends at most one row per component.
    """
    k1, k2 = row_key(doc_id, text)
    marked = marked_rows(docs, doc_id, text, k, percent)
    whole = F.xxhash64(*[F.col(quoted(c)) for c in docs.columns])
    rows = packed(docs, None, k1=k1, k2=k2, whole=whole)
    rows = rows.join(marked, F.expr("k1 = m1 AND k2 = m2"))
    id_ = F.col(f"doc.{quoted(doc_id)}").cast("long").asc_nulls_last()
    place = F.row_number().over(Window.partitionBy("component").orderBy(id_, "whole"))
    linked = rows.where("component IS NOT NULL").withColumn("place", place).where("place = 1")
    alone = rows.where("component IS NULL")
    return unpacked(linked.select("doc").union(alone.select("doc")), docs.columns)
