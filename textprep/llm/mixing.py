"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled (order of an md5 of the id) and laid end to end as a stream of
words, which is cut into blocks of ``block`` words; a source may be read up to ``max_epochs`` times.
A slot of the schedule is a van der Corput point mapped through the cumulative block counts of the
sources, so at every moment each source is within a few blocks of its share. The r-th slot of a
source takes block r of its stream, and joining slots to blocks tells which words of which document
come when. The slot that reaches a source's target takes the words still missing only.

Sizes are words ``[^\\x20\\x09-\\x0D]+``; null texts have none and are taken zero times. Null is a
source like any other and comes last. Rows with equal ids are documents of their own; copies of one
row are interchangeable. An empty table gives an empty mix. Further columns of the input are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from textprep.llm.common import WORD, Scratch, packed, quoted, row_key, unpacked

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK = 1024
SEED = "mix"
ROWS_PER_BUCKET = 1024
RUN = 1 << 16  # slots that one row of the schedule's plan stands for


class Mix(NamedTuple):
    """``documents``: one row per document. ``segments``: what each slot takes, in slot order."""

    documents: DataFrame
    segments: DataFrame


def whole_key(docs: DataFrame, doc_id: str) -> tuple[Column, Column]:
    """A row's id and the hash of all its values: only rows that are equal throughout are copies."""
    k1, _ = row_key(doc_id, doc_id)
    return k1, F.xxhash64(*[F.col(quoted(c)) for c in docs.columns]).alias("k2")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...], max_epochs: int, block: int
) -> DataFrame:
    """Targets of sources (``source, source_size``) by filling up to a common level.

    Sorted by the level at which they reach their limit, sources below the level are at their limit
    and the rest share what is left by weight. The windows hold one row per source.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1,
    )
    sources = sizes.withColumn("s", F.row_number().over(by_name)).withColumn("w", weight)
    sources = sources.withColumn("cap", F.col("source_size") * max_epochs)
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "s").rowsBetween(
        Window.unboundedPreceding, -1
    )
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    parts = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    sources = sources.select("*", rest.alias("rest"), parts.alias("parts"))
    capped = F.col("cap") / F.col("w") < F.col("rest") / F.col("parts")
    sources = sources.withColumn("capped", capped)
    first = F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "s", "rest", "parts"))
    sources = sources.withColumn("level", F.min(first).over(whole))
    shared = F.col("level.rest").cast("double") * F.col("w") / F.col("level.parts")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared)
    sources = sources.select("source", "s", "source_size", target.alias("target"))
    words = F.floor(F.col("target") + 0.5).cast("long")
    sources = sources.withColumn("words", words)
    epochs = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0)
    sources = sources.withColumn("epochs", epochs)
    sources = sources.withColumn("rest", F.expr("words - epochs * source_size"))
    sources = sources.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    slots = F.expr(f"epochs * blocks + (rest + {block - 1}) div {block}")
    return sources.withColumn("slots", slots)


def bit_reversed(column: str, bits: int) -> Column:
    return F.expr(f"cast(conv(reverse(lpad(bin({column}), {bits}, '0')), 2, 10) AS long)")


def schedule(sources: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """``slot, s, epoch, block, words``: which block of which source comes when.

    The 2^m points of a van der Corput sequence are a grid; a source owns the grid points between
    its cumulative shares, and bit reversal tells when each of them comes. Runs of grid points are
    expanded in parallel. A slot's rank in its source is counted in two steps, so that a source
    with a third of all slots is not ranked in one task.
    """
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(1, int(2 * total).bit_length())
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    edges = sources.withColumn("end", F.sum("slots").over(upto)).where("slots > 0")
    scale = f"* double({1 << bits}) / double({max(total, 1)})"
    edges = edges.withColumn("low", F.expr(f"ceil((end - slots) {scale})"))
    edges = edges.withColumn("high", F.expr(f"ceil(end {scale})"))
    edges = edges.select("s", "source_size", "epochs", "rest", "blocks", "slots", "low", "high")
    edges = scratch.save(edges, "edges", total)
    runs = edges.select("s", "high", F.explode(F.expr(f"sequence(low, high - 1, {RUN})")).alias("a"))
    points = runs.repartition("s", "a").select(
        "s", F.explode(F.expr(f"sequence(a, least(a + {RUN}, high) - 1)")).alias("point")
    )
    points = points.select("s", bit_reversed("point", bits).alias("slot"))
    points = points.withColumn("sector", F.expr(f"slot div {RUN}"))
    points = scratch.save(points, "points", 1 << bits)
    earlier = Window.partitionBy("s").orderBy("sector").rowsBetween(Window.unboundedPreceding, -1)
    sectors = points.groupBy("s", "sector").agg(F.count(F.lit(1)).alias("n"))
    sectors = scratch.save(
        sectors.select("s", "sector", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n")),
        "sectors", total,
    )
    inside = Window.partitionBy("s", "sector").orderBy("slot")
    ranked = points.withColumn("i", F.row_number().over(inside)).join(sectors, ["s", "sector"])
    ranked = ranked.select("s", "slot", F.expr("n + i - 1").alias("rank")).join(edges, "s")
    epoch = "least(rank div blocks, epochs)"
    ranked = ranked.where("rank < slots").selectExpr(
        "slot", "s", "source_size", "epochs", "rest", f"{epoch} AS epoch",
        f"rank - {epoch} * blocks AS block",
    )
    end = "if(epoch = epochs, rest, source_size)"
    words = f"least({block}, {end} - block * {block})"
    return ranked.selectExpr("slot", "s", "epoch", "block", f"{words} AS words")


def streams(sized: DataFrame, scratch: Scratch) -> DataFrame:
    """``sized`` with ``start``: the words before each document in its source's shuffled stream.

    Running sums in two steps over buckets of the order key, whose number follows the row count.
    """
    rows, digits = sized.count(), 1
    while rows > ROWS_PER_BUCKET * 16**digits:
        digits += 1
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    sums = scratch.save(
        sums.select("s", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n")),
        "bucket_sums", sized.count(),
    )
    inside = Window.partitionBy("s", "bucket").orderBy("key", "id", "size", "k2")
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    ended = sized.withColumn("end", F.sum("size").over(inside)).join(sums, ["s", "bucket"])
    return ended.select("id", "k1", "k2", "s", "size", F.expr("n + end - size").alias("start"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    block: int = BLOCK,
) -> Mix:
    """Mix the sources so that each comes within rounding of its target.

    ``documents``: ``id, k1, k2`` (the row's key), ``source, size, source_size, target, taken,
    copies``; ``taken`` counts words with repeats, ``copies`` the times a document is begun, for mixes of whole documents.
    ``segments``: ``slot, epoch, source, id, begin, words``, the words of a document that a slot
    takes; rerun or moved to another cluster, it is the same.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    id_ = F.col(quoted(doc_id))
    sized = docs.select(
        id_.alias("id"),
        *whole_key(docs, doc_id),
        F.col(quoted(source)).alias("source"),
        F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(SEED), id_.cast("string"))).alias("key"),
    )
    sized = scratch.save(sized, "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = sized.count()
    sources = scratch.save(source_targets(sizes, weights, max_epochs, block), "sources", rows)
    by_source = sources.select(F.col("source").alias("name"), "s")
    numbered = sized.join(by_source, F.col("source").eqNullSafe(F.col("name")))
    placed = scratch.save(streams(numbered.drop("source", "name"), scratch), "placed", 4 * rows)

    pieces = placed.where("size > 0").select(
        "*",
        F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"),
    )
    origin = f"block * {block}"
    pieces = pieces.selectExpr(
        "id", "s", "start", "block", f"greatest(start, {origin}) AS begin",
        f"least(start + size, {origin} + {block}) AS end",
    )
    slots = schedule(sources, block, scratch)
    taken = f"least(end, {origin} + words) - begin"
    segments = pieces.join(slots, ["s", "block"]).where(f"{taken} > 0")
    segments = segments.selectExpr(
        "slot", "epoch", "s", "start", "id", "begin - start AS begin", f"{taken} AS words"
    )
    segments = scratch.save(segments, "segments")
    sums = segments.groupBy("s", "start").agg(
        F.sum("words").alias("taken"), F.count_if(F.col("begin") == 0).alias("copies")
    )
    # Documents with words differ in their starts; those without have no segments.
    sums = sums.withColumn("some", F.lit(True))
    documents = placed.withColumn("some", F.col("size") > 0)
    documents = documents.join(sums, ["s", "start", "some"], "left").join(sources, "s")
    documents = documents.select(
        "id", "k1", "k2", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
    )
    return Mix(documents, segments.join(sources.select("s", "source"), "s").drop("s", "start"))


def mixed_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The mix as whole documents: each row as often as the mix begins it, with its columns.

    Rows that are equal in all columns share what is taken of them; rows that share only their id and
    text do not.
    """
    taken = mix(docs, doc_id, text, source).documents.groupBy("k1", "k2")
    taken = taken.agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    k1, k2 = whole_key(docs, doc_id)
    rows = packed(docs, k1=k1, k2=k2).dropDuplicates(["k1", "k2"])
    rows = rows.join(taken.hint("merge"), ["k1", "k2"])
    return unpacked(rows.select("doc", F.explode(F.expr("array_repeat(0, copies)"))), docs.columns)
