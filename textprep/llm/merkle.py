"""Merkle manifest of a table: a content-addressed DAG of digests, and inclusion proofs from it.

Each row is a leaf, the SHA-256 of its columns. Per partition value, leaves stand in order; every
``FANOUT`` consecutive nodes become the digest of their digests until one is left, the subroot. The
subroots, ordered by partition value, become the root in the same way.

The manifest is a table ``digest, children``, one record per digest. A proof descends from the root:
a leaf's address is the digits of its rank, base ``FANOUT``, first those of its partition, then those
of its place in it. Requests with a common beginning share a node, so each level of the descent joins
one row per node with its record, follows the requested digits and keeps the children beside them as
left and right siblings. The segments met on the way down, reversed, are the path from leaf to root.

Null values of a column are written ``-``. Null partition values and order keys come first. Rows with
equal order keys stand in the order of their digests; repeated rows are leaves of their own. An empty
table has no records, no root and no proofs. Other columns of the table never enter a leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from textprep.llm.common import Scratch, quoted

FANOUT = 8
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    size = F.octet_length(value).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(size, F.lit(":"), value))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def octal(rank: str, width: Column) -> Column:
    """``rank`` in base ``FANOUT`` with ``width`` digits."""
    digits = F.conv(F.col(rank).cast("string"), 10, FANOUT)
    return F.when(width == 0, "").otherwise(F.lpad(digits, width, "0"))


def height(nodes: Column) -> Column:
    """How many levels stand over ``nodes`` leaves."""
    return F.when(nodes <= 1, 0).otherwise(
        F.length(F.conv((nodes - 1).cast("string"), 10, FANOUT))
    )


def ranked(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], count: int, scratch: Scratch, name: str
) -> DataFrame:
    """``rows`` with ``rank``, the copies before a row among those equal in ``by``, and their ``total``.

    ``rows``, at most ``count``, have distinct ``by`` and ``order``, and say in ``copies`` how often
    each occurs. They are dealt into ranges, which the written table fixes; sums of the ranges tell
    where each one starts.
    """
    dealt = rows.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id())
    dealt = scratch.save(dealt, name, count)
    sums = dealt.groupBy("range", *by).agg(F.sum("copies").alias("sum"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("range").alias("r"), *[F.col(b).alias(f"of_{b}") for b in by],
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"),
        F.sum("sum").over(whole).alias("total"),
    )
    same = F.col("range") == F.col("r")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"of_{b}"))
    within = Window.partitionBy("range", *by).orderBy(*order)
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("copies").over(within), F.lit(0))
    placed = dealt.withColumn("earlier", earlier).join(sums, same)
    return placed.select(*rows.columns, (F.col("start") + F.col("earlier")).alias("rank"), "total")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the given columns, ``leaf`` and ``address``; ``records``: ``digest, children``."""

    leaves: DataFrame
    records: DataFrame
    root: str | None
    size: int  # leaves
    top: int  # digits of an address that name the partition
    depth: int  # digits of the longest address
    scratch: Scratch


def tree(nodes: DataFrame, levels: int, size: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Records over ``part, rank, total, digest``, and ``part, digest`` of each part's last node."""
    records, tops = [], []
    for level in range(levels + 1):
        tops.append(nodes.where("total = 1").select("part", "digest"))
        if level == levels:
            break
        runs = nodes.where("total > 1").groupBy("part", F.expr(f"rank div {FANOUT}").alias("run"))
        runs = runs.agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("nodes"),
            F.first("total").alias("total"),
        )
        children = F.col("nodes.digest")
        nodes = scratch.save(
            runs.select(
                "part", F.col("run").alias("rank"),
                F.expr(f"(total + {FANOUT - 1}) div {FANOUT}").alias("total"),
                F.sha2(F.array_join(children, "").cast("binary"), 256).alias("digest"),
                children.alias("children"),
            ),
            f"{name}{level}", size // FANOUT ** (level + 1),
        )
        records.append(nodes.select("digest", "children"))
        nodes = nodes.drop("children")
    last = tops[0]
    for more in tops[1:]:
        last = last.union(more)
    if not records:
        return nodes.select("digest", F.lit(None).cast("array<string>").alias("children")).limit(0), last
    every = records[0]
    for more in records[1:]:
        every = every.union(more)
    return every, last


def build_manifest(
    docs: DataFrame,
    leaf_digest: Column,
    partition: str = "lang",
    order: str = "doc_id",
    **columns: Column,
) -> Manifest:
    """The manifest of ``docs``; ``columns`` go with the leaves and must follow from a row's content."""
    scratch = Scratch(docs.sparkSession, "merkle")
    extra = [c.alias(k) for k, c in columns.items()]
    rows = docs.select(
        F.col(quoted(partition)).alias("partition"), F.col(quoted(order)).alias("key"),
        leaf_digest.alias("leaf"), *extra,
    )
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    size = docs.count()
    rows = ranked(rows, ["partition"], ["key", "leaf", *columns], size, scratch, "rows")
    rows = scratch.save(rows, "ranked", size)

    parts = rows.groupBy("partition").agg(F.first("total").alias("nodes"))
    parts = ranked(parts.withColumn("copies", F.lit(1)), [], ["partition"], size, scratch, "parts")
    parts = parts.select(
        F.col("partition").alias("p"), F.col("rank").alias("part"), "nodes",
        F.col("total").alias("parts"),
    )
    parts = scratch.save(parts, "numbered", size)
    sizes = parts.agg(F.max(height(F.col("nodes"))), F.max(height(F.col("parts")))).first()
    low, top = sizes[0] or 0, sizes[1] or 0

    leaves = rows.join(parts, F.col("partition").eqNullSafe(F.col("p")))
    # Repeated rows take consecutive places.
    leaves = leaves.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    leaves = leaves.withColumn("rank", F.col("rank") + F.col("copy"))
    address = F.concat(octal("part", F.lit(top)), octal("rank", height(F.col("nodes"))))
    leaves = leaves.select("part", "rank", "total", "leaf", *columns, address.alias("address"))
    leaves = scratch.save(leaves, "leaves", size)
    nodes = leaves.select("part", "rank", "total", F.col("leaf").alias("digest"))
    inner, subroots = tree(nodes, low, size, scratch, "level")
    subroots = subroots.join(parts.select("part", "parts"), "part")
    over = subroots.select(
        F.lit(0).cast("long").alias("part"), F.col("part").alias("rank"),
        F.col("parts").alias("total"), "digest",
    )
    outer, root = tree(scratch.save(over, "subroots", size), top, size, scratch, "top")
    records = inner.union(outer).groupBy("digest").agg(F.first("children").alias("children"))
    records = scratch.save(records, "records", size)
    row = root.select("digest").first()
    given = leaves.select("leaf", *columns, "address")
    return Manifest(given, records, row and row[0], size, top, top + low, scratch)


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (with ``address``) and their ``path``, ``subroot`` and ``root``.

    ``path`` has one step per level, from the leaf up: the digests ``left`` and ``right`` of the node.
    """
    scratch = manifest.scratch
    spark = requests.sparkSession
    requests = requests.withColumn("parent", F.expr("left(address, length(address) - 1)"))
    # One row per node that some request passes.
    nodes = requests.select("parent").distinct().select(
        F.explode(F.expr("transform(sequence(0, length(parent)), i -> left(parent, i))")).alias("p")
    )
    nodes = scratch.save(nodes.distinct(), "passed", manifest.size)
    start = [("", manifest.root, [], manifest.root if manifest.top == 0 else None)]
    met = spark.createDataFrame(start, f"prefix string, digest string, steps {PATH}, subroot string")
    opened = []
    for level in range(max(1, manifest.depth)):
        here = met.join(manifest.records, "digest").select("prefix", "children", "steps", "subroot")
        here = scratch.save(here, f"opened{level}", min(manifest.size, 4 * FANOUT**level))
        opened.append(here)
        below = here.select("*", F.posexplode("children").alias("digit", "digest"))
        below = below.withColumn("q", F.concat("prefix", F.col("digit").cast("string")))
        below = below.join(nodes.where(F.length("p") == level + 1), F.col("q") == F.col("p"))
        subroot = F.col("digest") if level + 1 == manifest.top else F.col("subroot")
        met = below.select(
            F.col("q").alias("prefix"), "digest",
            F.concat("steps", F.array(beside("children", "digit"))).alias("steps"),
            subroot.alias("subroot"),
        )
    every = opened[0]
    for more in opened[1:]:
        every = every.union(more)
    alone = requests.where("address = ''").select(
        *requests.columns, F.array().cast(PATH).alias("path"), F.lit(manifest.root).alias("subroot")
    )
    met = requests.where("address <> ''").join(every, F.col("parent") == F.col("prefix"))
    met = met.withColumn("digit", F.expr("int(right(address, 1))"))
    path = F.reverse(F.concat("steps", F.array(beside("children", "digit"))))
    child = F.element_at("children", F.col("digit") + 1)
    is_subroot = F.length("address") == manifest.top
    subroot = F.when(is_subroot, child).otherwise(F.col("subroot"))
    met = met.select(*requests.columns, path.alias("path"), subroot.alias("subroot"))
    proofs = met.union(alone).drop("parent")
    return proofs.withColumn("root", F.lit(manifest.root).cast("string"))


def beside(children: str, digit: str) -> Column:
    """The children left and right of the selected one."""
    left = F.expr(f"slice({children}, 1, {digit})")
    right = F.expr(f"slice({children}, {digit} + 2, greatest(size({children}) - {digit} - 1, 0))")
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def siblings_digest(path: str) -> Column:
    """The digest of all siblings on the way, left to right and level by level."""
    steps = F.transform(path, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(steps, "").cast("binary"), 256)


def folded(path: str, start: Column) -> Column:
    """The root that ``start`` leads to along a path."""
    return F.aggregate(path, start, lambda node, s: digest(s["left"], node, s["right"]))
