"""CSV files with line breaks inside quotes, read by many tasks.

A task that starts in the middle of a file cannot know whether it starts inside quotes. So the lines
of every split are first scanned for both cases: where would the split end, inside or outside, if it
began outside, and if it began inside? These transitions are composed along each file, which tells
how every split really begins. The second scan then cuts the lines at true record ends, and Spark
parses the records. A record that crosses splits comes as a fragment from each of them; the fragments
of a record are gathered and joined in order.

Quotes follow the parser of Spark: one opens a field only at the field's beginning and is a plain
character elsewhere outside quotes; inside, two of them are one, and one alone closes the field, whose
rest up to the separator is taken as it is. A record ends at ``\\n`` outside quotes; in files whose
first line ends with ``\\r\\n`` all lines lose a final ``\\r``. Empty lines between records are
skipped, and with ``header`` the first record of each file. If a file ends inside quotes, its last
record runs to its end, without the final line break.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import nullcontext
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from textprep.sources.scratch import batches_of, materialize, session_setting

QUOTE = b'"'
#: Lines that are sent to Python at once: a line may be a whole text.
LINES_A_BATCH = 500
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}
PLACE = ("row_file", "row_block", "row_id")


class Start(NamedTuple):
    """How a split begins: inside quotes or not, and where the record open there began."""

    inside: bool
    owner: int | None


def ends_inside(line: bytes, inside: bool, separator: bytes) -> bool:
    """Whether a record is inside quotes after a physical line."""
    at = 0
    while True:
        if not inside:
            at = line.find(QUOTE, at)
            while at > 0 and line[at - 1 : at] != separator:
                at = line.find(QUOTE, at + 1)
            if at < 0:
                return False
            at += 1
        at = line.find(QUOTE, at)
        if at < 0:
            return True
        if line[at + 1 : at + 2] == QUOTE:
            at, inside = at + 2, True
            continue
        at = line.find(separator, at)
        if at < 0:
            return False
        at, inside = at + 1, False


def transitions(lines: DataFrame, separator: bytes) -> DataFrame:
    """``file, block, outside, inside, closes, crlf``, one row per split.

    ``outside`` and ``inside`` tell whether the split ends inside quotes if it begins outside or
    inside; ``closes`` whether a record ends in it if it begins inside; ``crlf`` whether its first
    line ends with a carriage return.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state = None, []
        out: list[tuple] = []
        for batch in batches:
            for key, line in located(batch):
                if key != split:
                    out += [(*split, *state)] if split else []
                    split, state = key, [False, True, False, line.endswith(b"\r")]
                if QUOTE in line:
                    state[:2] = [ends_inside(line, s, separator) for s in state[:2]]
                state[2] |= not state[1]
        out += [(*split, *state)] if split else []
        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)

    names = ["file", "block", "outside", "inside", "closes", "crlf"]
    kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
    schema = pa.schema(list(zip(names, kinds)))
    return lines.mapInArrow(
        rows, "file string, block long, outside boolean, inside boolean, closes boolean, crlf boolean"
    )


def located(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], bytes]]:
    """((file, block), line) of each row."""
    file, block, value = (c.to_pylist() for c in batch.columns)
    return zip(zip(file, block), value)


def composed(transitions: list) -> dict[tuple[str, int], Start]:
    """How each split begins, for those that do not begin outside quotes.

    The driver holds one small row per split here, of which its scheduler holds a task each.
    """
    starts: dict[tuple[str, int], Start] = {}
    file, inside, owner = None, False, None
    for t in sorted(transitions, key=lambda t: (t.file, t.block)):
        if t.file != file:
            file, inside, owner = t.file, False, None
        if inside:
            starts[t.file, t.block] = Start(True, owner)
        if not inside or t.closes:
            owner = t.block
        inside = t.inside if inside else t.outside
    return starts


def cut_records(
    lines: DataFrame, starts: dict, crlf: set[str], separator: bytes, header: bool
) -> DataFrame:
    """``file, block, line, owner, first, record``: records, and fragments of those across splits.

    ``line`` is the number, within its split, of the line where a record begins; ``owner`` is null
    for whole records, and for fragments the split where the record begins.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, owner, number, begin, first = None, False, None, 0, 0, False
        held: list[bytes] = []

        def fragment() -> list[tuple]:
            """What a split leaves open at its end."""
            return [(*split, begin, split[1] if owner is None else owner, first, b"\n".join(held))] if held else []

        for batch in batches:
            out: list[tuple] = []
            for key, line in located(batch):
                if key != split:
                    out += fragment() if split else []
                    split, held, number, begin = key, [], 0, 0
                    inside, owner = starts.get(key, (False, None))
                    first = header and key[1] == 0
                held.append(line.removesuffix(b"\r") if key[0] in crlf else line)
                number += 1
                if QUOTE in line:
                    inside = ends_inside(line, inside, separator)
                if not inside:
                    record = b"\n".join(held)
                    if record or owner is not None:
                        out.append((*key, begin, owner, first, record))
                        first = False
                    held, begin, owner = [], number, None
            yield batch_of(out)
        yield batch_of(fragment() if split else [])

    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("owner", pa.int64()),
        ("first", pa.bool_()), ("record", pa.binary()),
    ])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return lines.mapInArrow(
        rows, "file string, block long, line long, owner long, first boolean, record binary"
    )


def splits_of(spark: SparkSession, size: int):
    """Actions inside read files in splits of at most ``size`` bytes."""
    return session_setting(spark, "spark.sql.files.maxPartitionBytes", size)


def size_in_bytes(setting: str) -> int:
    """Bytes of a setting such as ``128MB``, ``134217728b`` or ``134217728``."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", setting.strip().lower()).groups()
    return int(number) << 10 * ("kmgtp".index(unit) + 1 if unit else 0)


def tasks_of(lines: DataFrame, split_bytes: int | None, usual: int) -> int:
    """Tasks for splits of ``split_bytes``: as many as for usual ones, but work for all cores."""
    splits = lines.rdd.getNumPartitions()
    if not split_bytes or split_bytes >= usual:
        return splits
    cores = lines.sparkSession.sparkContext.defaultParallelism
    return max(1, min(splits, max(2 * cores, -(-splits * split_bytes // usual))))


def read_records(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    separator: str = ",",
    header: bool = True,
    place: bool = False,
    split_bytes: int | None = None,
) -> DataFrame:
    """A table from CSV files whose quoted fields may hold line breaks, each file read by many tasks.

    The files are scanned twice, and the parsed rows stored in the shared scratch folder. ``place``
    adds the columns ``PLACE``, which put rows in file order. ``split_bytes`` replaces the session's
    ``spark.sql.files.maxPartitionBytes`` for the scans; a task takes as many smaller splits as
    make a split of the usual size, so tasks and stored files do not become more.
    """
    usual = size_in_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    splits = splits_of(spark, split_bytes) if split_bytes else nullcontext()
    with splits, batches_of(spark, LINES_A_BATCH):
        lines = spark.read.option("lineSep", "\n").text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("value"),
        )
        lines = lines.coalesce(tasks_of(lines, split_bytes, usual))
        mark = separator.encode()
        scanned = transitions(lines, mark).collect()
        starts = composed(scanned)
        crlf = {t.file for t in scanned if t.block == 0 and t.crlf}
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)

        def parsed(record):
            return F.from_csv(record.cast("string"), ddl, {**OPTIONS, "sep": separator})

        whole = F.col("owner").isNull()
        cut = cut_records(lines, starts, crlf, mark, header).where(~(F.col("first") & whole))
        cut = cut.select(
            "file", "block", "line", "owner", "first",
            F.when(~whole, F.col("record")).alias("record"),
            F.when(whole, parsed(F.col("record"))).alias("row"),
        )
        cut = materialize(cut, "csv")
    parts = cut.where("owner IS NOT NULL").groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("block", "record", "line", "first"))).alias("parts")
    )
    joined = F.array_join(F.transform("parts.record", lambda r: r.cast("string")), "\n")
    parts = parts.where("NOT parts[0].first").select(
        "file", F.col("owner").alias("block"), F.col("parts")[0]["line"].alias("line"),
        parsed(joined).alias("row"),
    )
    rows = cut.where("owner IS NULL").select("file", "block", "line", "row").union(parts)
    places = [F.col(c).alias(n) for c, n in zip(("file", "block", "line"), PLACE)] if place else []
    names = [F.col("row")[f.name].alias(f.name) for f in schema]
    return rows.select(*names, *places)
