"""Document fingerprints by winnowing, in DataFrame expressions only.

Units are words ``[^\\x20\\x09-\\x0D]+``; characters of scripts written without spaces are units of
their own. Each run of ``K`` units gets a polynomial hash, and of every ``WINDOW`` runs the least
hash is kept, the rightmost of equal ones, with its position. So two texts that share
``WINDOW + K - 1`` units in a row share a hash, and the positions say where.

Hash and reversed position are packed into one long, whose minimum is the least hash at its
rightmost position. A text of fewer than ``K`` units has one hash; null, empty and blank texts have
none and are like each other (likeness 1), and like nothing else (0). Rows with equal ids and texts
are one document; rows with equal ids and other texts follow each other in a fixed order; null ids
come first. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textprep.llm.common import Scratch, quoted, row_key

K, WINDOW = 3, 4
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
UNIT = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"
BASE, MODULUS = 1_000_003, 2**31 - 1
POSITION = 2**32  # hashes of 31 bits above, reversed positions of 32 bits below


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = K, w: int = WINDOW) -> DataFrame:
    """Add the packed fingerprint of a text column as an array, in text order."""
    units, grams = f"{name}_units", f"{name}_grams"
    found = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    df = df.withColumn(units, F.transform(found, lambda u: F.pmod(F.xxhash64(u), F.lit(MODULUS))))
    rolled = f"{units}[i]"
    for j in range(1, k):
        rolled = f"({rolled} * {BASE} + {units}[i + {j}]) % {MODULUS}"
    packed = f"({{}}) * {POSITION} + ({POSITION - 1} - i)"
    few = f"transform(array(0L), i -> {packed.format(f'pmod(xxhash64({units}), {MODULUS})')})"
    many = f"transform(sequence(0L, size({units}) - {k}L), i -> {packed.format(rolled)})"
    none = "cast(array() AS array<bigint>)"
    df = df.withColumn(
        grams,
        F.expr(f"CASE WHEN size({units}) = 0 THEN {none} WHEN size({units}) < {k} THEN {few} ELSE {many} END"),
    )
    window = ", ".join(f"{grams}[i + {j}]" for j in range(w))
    least = f"transform(sequence(0, size({grams}) - {w}), i -> least({window}))"
    chosen = f"CASE WHEN size({grams}) < 2 THEN {grams} WHEN size({grams}) < {w} THEN array(array_min({grams})) ELSE array_distinct({least}) END"
    return df.withColumn(name, F.expr(chosen)).drop(units, grams)


def hashes(packed: Column | str) -> Column:
    """The hashes of a packed fingerprint in text order."""
    return F.transform(packed, lambda x: F.shiftright(x, 32).cast("int"))


def positions(packed: Column | str) -> Column:
    """Where the hashes of :func:`hashes` begin, in units from 0."""
    last = F.lit(POSITION - 1)
    return F.transform(packed, lambda x: last - x.bitwiseAND(last))


def as_text(packed: Column | str) -> Column:
    """Hashes in text order as eight hexadecimal digits each."""
    return F.array_join(F.transform(hashes(packed), lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(one: str, two: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    common = F.size(F.array_intersect(one, two))
    union = F.size(one) + F.size(two) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def next_documents(docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """``k1, k2, n, n1, n2``: a document's key and length, and the key of the one after it.

    Keys are sorted by range; the row after the last one of a part is the first of the next part,
    and the windows hold one part, or one row per part.
    """
    k1, k2 = row_key(doc_id, text)
    length = F.length(F.coalesce(F.col(quoted(text)), F.lit(""))).cast("long")
    keys = docs.select(k1, k2, length.alias("n")).distinct()
    parts = keys.repartitionByRange("k1", "k2").withColumn("part", F.spark_partition_id())
    parts = scratch.save(parts, "parts")
    inside = Window.partitionBy("part").orderBy("k1", "k2")
    key = F.struct("k1", "k2")
    parts = parts.select("*", F.lead(key).over(inside).alias("after"))
    firsts = parts.groupBy("part").agg(F.min(key).alias("first"))
    in_order = Window.orderBy("part")
    everything = Window.partitionBy()
    following = F.coalesce(F.lead("first").over(in_order), F.min("first").over(everything))
    firsts = firsts.select("part", following.alias("following"))
    after = F.coalesce("after", "following")
    linked = parts.join(firsts, "part").select("k1", "k2", "n", after.alias("after"))
    return linked.select("k1", "k2", "n", F.col("after.k1").alias("n1"), F.col("after.k2").alias("n2"))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its fingerprint, that of its edited text, and that of the next document.

    The edited text has its last quarter of code points replaced by the first as many of the next
    document by id. Texts are shuffled once; a second exchange takes to each document the start and
    the hashes of the next one only.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    order = scratch.save(next_documents(docs, doc_id, text, scratch), "order")
    k1, k2 = row_key(doc_id, text)
    # Both joins read the same columns, so Spark shuffles the texts once for the two of them.
    texts = docs.select(k1, k2, F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    texts = with_fingerprint(texts.repartition("k1", "k2"), "text", "packed")
    own = texts.join(order.hint("merge"), ["k1", "k2"])
    before = order.select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.expr("n div 4").alias("need"),
        F.col("n1").alias("k1"), F.col("n2").alias("k2"),
    )
    following = texts.join(before.hint("merge"), ["k1", "k2"]).select(
        F.col("p1").alias("k1"), F.col("p2").alias("k2"),
        F.expr("left(text, cast(need AS int))").alias("start"),
        F.array_distinct(hashes("packed")).alias("next_set"),
    )
    joined = own.join(following.dropDuplicates(["k1", "k2"]), ["k1", "k2"])
    edited = F.expr("concat(left(text, cast(n - n div 4 AS int)), start)")
    id_ = F.when(F.col("k1") != F.lit(-(2**63)), F.col("k1")).alias("id")
    joined = joined.select(id_, "text", "n", "packed", "next_set", edited.alias("edited"))
    joined = with_fingerprint(joined, "edited", "edited_packed")
    for name in ("packed", "edited_packed"):
        joined = joined.withColumn(f"{name}_set", F.array_distinct(hashes(name)))
    return joined.select(
        "id", "text", F.col("n").alias("n_chars"), "edited",
        as_text("packed").alias("fingerprint"),
        as_text("edited_packed").alias("edited_fingerprint"),
        positions("packed").alias("positions"),
        likeness("packed_set", "edited_packed_set").alias("near_edited"),
        likeness("packed_set", "next_set").alias("near_next"),
    )
