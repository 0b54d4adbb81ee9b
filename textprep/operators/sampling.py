"""Exact, seeded sampling that does not depend on partitioning.

Rows are ordered by ``md5(id | seed)``, ties by id. "The first n rows of a class" then means the
same rows on any cluster layout. The ids given must identify rows and must not be null.

Two building blocks keep this distributed although there are only a few classes:

* :func:`distributed_rank` ranks every row. Rows are spread over (class, bucket) groups, the bucket
  being a prefix of the hash key, and a bucket's start is the running sum of the sizes before it.
* :func:`first_per_class` only marks the first n rows of each class. It finds the key of row n from
  the bucket sizes plus one bucket per class, and then compares keys, so the rows themselves are
  never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textprep.schema import BINARY_LABELS

SEED = 42

# 16 ** 3 = 4,096 buckets per class: 10 billion rows of a class make 2.4 million rows per bucket.
# The result does not depend on the number of buckets.
BUCKET_DIGITS = 3
MAX_BUCKET_DIGITS = 5
ROWS_PER_BUCKET = 50_000

DRAWS_PER_KEY = 100_000

#: Tables of one row per class are broadcast up to so many classes.
MAX_BROADCAST_CLASSES = 1000


def order_key(ids: Sequence[str], seed: int = SEED) -> Column:
    """Pseudo-random order key of a row: ``md5(id|..|seed)`` as hex."""
    return F.md5(F.concat_ws("|", *[F.col(i) for i in ids], F.lit(str(seed))))


def _keyed(df: DataFrame, ids: Sequence[str], seed: int, digits: int) -> DataFrame:
    df = df.withColumn("_key", order_key(ids, seed))
    return df.withColumn("_bucket", F.substring("_key", 1, digits))


def bucket_digits(n_rows: int) -> int:
    """Prefix length that keeps buckets of ``n_rows`` near ``ROWS_PER_BUCKET``, at most 5."""
    digits = BUCKET_DIGITS
    while digits < MAX_BUCKET_DIGITS and n_rows > ROWS_PER_BUCKET * 16**digits:
        digits += 1
    return digits


def class_extent(df: DataFrame, class_col: str) -> tuple[int, int]:
    """Number of classes and rows of the largest one; only that column is read."""
    sizes = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    return row[0], row[1] or 0


def largest_class(df: DataFrame, class_col: str | None) -> int:
    """Rows of the most frequent value, or all rows."""
    return df.count() if class_col is None else class_extent(df, class_col)[1]


def distributed_rank(
    df: DataFrame,
    ids: Sequence[str],
    class_col: str | None = None,
    seed: int = SEED,
    rank: str = "rank",
    digits: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row within its class (or overall without ``class_col``).

    One exchange of the rows, by (class, bucket); the bucket sizes are joined on the same key.
    Without ``digits`` the largest class is counted first, and buckets are sized by it.
    """
    digits = digits or bucket_digits(largest_class(df, class_col))
    cls = F.col(class_col).cast("string") if class_col else F.lit("")
    # A null class is a class of its own.
    tag = F.when(cls.isNull(), "null").otherwise(F.concat(F.lit("="), cls))
    keyed = _keyed(df, ids, seed, digits).withColumn("_group", F.concat_ws("|", "_bucket", tag))

    sizes = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    in_class = F.expr(f"substring(_group, {digits + 2})")
    before = (
        Window.partitionBy(in_class)
        .orderBy("_group")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select(
        "_group", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )

    in_group = Window.partitionBy("_group").orderBy("_key", *ids)
    local = keyed.withColumn("_local", F.row_number().over(in_group))
    return (
        local.join(starts, "_group")
        .withColumn(rank, F.col("_start") + F.col("_local"))
        .drop("_key", "_bucket", "_group", "_local", "_start")
    )


def _bucket_sizes(keyed: DataFrame, class_col: str) -> DataFrame:
    """(class, bucket) sizes with the class total; at most ``classes * 16**digits`` rows."""
    sizes = keyed.groupBy("_class", class_col, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    total = F.sum("_size").over(Window.partitionBy(class_col))
    return sizes.withColumn("_total", total)


def _smallest_class_quota(sizes: DataFrame, class_col: str) -> DataFrame:
    return sizes.withColumn("_quota", F.min("_total").over(Window.partitionBy()))


def _stratified_quota(sizes: DataFrame, class_col: str, fraction: float) -> DataFrame:
    """Largest-remainder share of ``ceil(fraction * n)`` rows; ties go to the lower class."""
    whole = Window.partitionBy()
    n = F.sum("_size").over(whole)
    first_of_class = F.row_number().over(Window.partitionBy(class_col).orderBy("_bucket")) == 1
    wide = "decimal(19,0)"
    product = F.col("_total").cast(wide) * F.col("_n_test").cast(wide)
    return (
        sizes.withColumn("_n", n)
        .withColumn("_n_test", F.ceil(F.lit(float(fraction)) * F.col("_n")))
        .withColumn("_rest", (product % F.col("_n").cast(wide)).cast("bigint"))
        .withColumn(
            "_floor",
            ((product - F.col("_rest")) / F.col("_n").cast(wide)).cast("bigint"),
        )
        .withColumn("_first", first_of_class)
        .withColumn(
            "_left",
            F.col("_n_test") - F.sum(F.when(F.col("_first"), F.col("_floor"))).over(whole),
        )
        .withColumn(
            "_place",
            F.dense_rank().over(Window.orderBy(F.desc("_rest"), class_col)),
        )
        .withColumn(
            "_quota",
            F.col("_floor") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0),
        )
    )


def first_per_class(
    df: DataFrame,
    ids: Sequence[str],
    class_col: str,
    quota,
    classes: Sequence[int] | None = BINARY_LABELS,
    seed: int = SEED,
    digits: int | None = None,
    mark: str = "_chosen",
) -> DataFrame:
    """Mark exactly the first ``quota`` rows of each class.

    Rows of other ``classes`` are dropped; with ``None`` every label counts, null as a class of its
    own. ``quota`` maps the bucket sizes to the same table with a ``_quota`` column. Only ids and
    class are read to find the last chosen key of each class. The tables joined to the rows hold
    one row per class; they are counted, and broadcast up to ``MAX_BROADCAST_CLASSES`` of them, so
    the rows stay in their partitions. With more classes the chosen ids are joined to the rows.
    """
    if classes is not None:
        df = df.where(F.col(class_col).isin(*classes))
    n_classes, n_largest = class_extent(df, class_col)
    few = n_classes <= MAX_BROADCAST_CLASSES
    small = F.broadcast if few else lambda table: table
    digits = digits or bucket_digits(n_largest)
    value = F.col(class_col).cast("string")
    tag = F.when(value.isNull(), "null").otherwise(F.concat(F.lit("="), value))
    keyed = _keyed(df, ids, seed, digits).withColumn("_class", tag)
    narrow = keyed.select("_class", class_col, "_bucket", "_key", *ids)

    running = Window.partitionBy(class_col).orderBy("_bucket")
    last_bucket = (
        quota(_bucket_sizes(narrow, class_col), class_col)
        .withColumn("_upto", F.sum("_size").over(running))
        .withColumn("_need", F.col("_quota") - (F.col("_upto") - F.col("_size")))
        .where((F.col("_need") > 0) & (F.col("_quota") <= F.col("_upto")))
        .select("_class", "_bucket", "_need")
    )
    place = F.row_number().over(Window.partitionBy("_class").orderBy("_key", *ids))
    last_row = (
        narrow.join(small(last_bucket), ["_class", "_bucket"])
        .withColumn("_place", place)
        .where(F.col("_place") == F.col("_need"))
        .select("_class", F.struct("_key", *ids).alias("_last"))
    )
    chosen = F.struct("_key", *ids) <= F.col("_last")
    if few:
        marked = keyed.join(small(last_row), "_class", "left")
        marked = marked.withColumn(mark, F.coalesce(chosen, F.lit(False)))
        return marked.drop("_key", "_bucket", "_class", "_last")
    picked = narrow.join(last_row, "_class").where(chosen).select(*ids, F.lit(True).alias(mark))
    marked = df.join(picked, list(ids), "left")
    return marked.withColumn(mark, F.coalesce(mark, F.lit(False)))


def undersample(
    df: DataFrame,
    ids: Sequence[str],
    label: str = "label",
    classes: Sequence[int] = BINARY_LABELS,
    seed: int = SEED,
) -> DataFrame:
    """Cut every class to the size of the smallest one, without replacement."""
    marked = first_per_class(df, ids, label, _smallest_class_quota, classes, seed)
    return marked.where("_chosen").drop("_chosen")


def stratified_split(
    df: DataFrame,
    ids: Sequence[str],
    fraction: float,
    label: str = "label",
    classes: Sequence[int] | None = None,
    seed: int = SEED,
    names: tuple[str, str] = ("train", "validation"),
) -> DataFrame:
    """Add ``split``: exactly ``ceil(fraction * n)`` validation rows in class proportion.

    All rows are kept, each label being a class, null too; ``classes`` restricts the table first.
    """

    def quota(sizes, class_col):
        return _stratified_quota(sizes, class_col, fraction)

    marked = first_per_class(df, ids, label, quota, classes, seed)
    split = F.when(F.col("_chosen"), names[1]).otherwise(names[0])
    return marked.withColumn("split", split).drop("_chosen")


def class_sizes(
    df: DataFrame, label: str = "label", classes: Sequence[int] = BINARY_LABELS
) -> dict[int, int]:
    """Rows per class as driver numbers; at most ``len(classes)`` values are collected."""
    rows = df.where(F.col(label).isin(*classes)).groupBy(label).count().collect()
    return {r[label]: r["count"] for r in rows}


def draw_rank(draw: Column, class_value: Column, n: Column | int, seed: int = SEED) -> Column:
    """Uniform draw from ``1..n``: the first 60 bits of ``md5(draw|class|seed)`` modulo n."""
    digest = F.md5(F.concat_ws("|", draw, class_value, F.lit(str(seed))))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return number % n + 1


def oversample(
    df: DataFrame,
    ids: Sequence[str],
    label: str = "label",
    classes: Sequence[int] = BINARY_LABELS,
    seed: int = SEED,
) -> DataFrame:
    """Redraw every smaller class, with replacement, to the size of the largest one.

    The largest class (the lowest label among equals) is kept as it is. ``draw`` numbers the draws
    of a class from 0 and is null for kept rows. The draws come from ``spark.range``, so they are
    generated in parallel. If a tiny class is drawn very often, its rows are salted: a join key
    then takes about ``DRAWS_PER_KEY`` draws.
    """
    sizes = class_sizes(df, label, classes)
    df = df.where(F.col(label).isin(*classes))
    if len(sizes) < 2:
        return df.withColumn("draw", F.lit(None).cast("bigint"))
    n_max = max(sizes.values())
    largest = min(c for c, n in sizes.items() if n == n_max)
    result = df.where(F.col(label) == largest).withColumn("draw", F.lit(None).cast("bigint"))
    for value in sorted(c for c in sizes if c != largest):
        salts = max(1, n_max // (sizes[value] * DRAWS_PER_KEY))
        rows = df.where(F.col(label) == value)
        digits = bucket_digits(sizes[value])
        salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        ranked = distributed_rank(rows, ids, None, seed, "_rank", digits)
        ranked = ranked.withColumn("_salt", salt)
        draws = df.sparkSession.range(n_max).select(
            F.col("id").alias("draw"),
            draw_rank(F.col("id"), F.lit(value), F.lit(sizes[value]), seed).alias("_rank"),
            (F.col("id") % salts).cast("int").alias("_salt"),
        )
        drawn = draws.join(ranked, ["_rank", "_salt"]).drop("_rank", "_salt")
        result = result.unionByName(drawn)
    return result


def balance(
    df: DataFrame,
    ids: Sequence[str],
    strategy: str = "under",
    label: str = "label",
    classes: Sequence[int] = BINARY_LABELS,
    seed: int = SEED,
) -> DataFrame:
    """``under``, ``over`` or ``none``; all three keep only rows of ``classes``."""
    if strategy == "under":
        return undersample(df, ids, label, classes, seed)
    if strategy == "over":
        return oversample(df, ids, label, classes, seed)
    if strategy == "none":
        return df.where(F.col(label).isin(*classes))
    raise ValueError(f"unknown balancing strategy {strategy!r}")


def shuffle_rows(df: DataFrame, ids: Sequence[str], seed: int = SEED) -> DataFrame:
    """Rows in seeded random order (a range exchange, as written files need)."""
    return df.orderBy(order_key(ids, seed), *ids)


def preview(df: DataFrame, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    """First ``n`` rows in ``order``."""
    return df.orderBy(*order).limit(n)
