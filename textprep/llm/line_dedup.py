"""Line deduplication: lines that many documents share are dropped everywhere.

Each text is split at line feeds and every line is normalised to a key: white space stripped at both
ends, A-Z lower-cased. The distinct keys of a document are hashed to 128 bits and exploded to rows;
a hash found in ``min_docs`` rows or more loses all its lines, and the rest are joined again in the
order of their positions.

Null and empty texts are one empty line. The empty key is never dropped. Every row counts as a
document, also where ids repeat; equal rows get equal results. Further columns are kept, whatever
their names; ``n_lines`` and ``n_dropped`` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from textprep.llm.common import Scratch, packed, quoted, row_key, sliced, texts_of, unpacked

MIN_DOCS = 10
KEYS = "k1 long, k2 long, h1 long, h2 long, positions array<int>"


def line_key(line: bytes) -> bytes:
    """``bytes`` methods know ASCII only: strip takes x20 and x09-x0D, lower takes A-Z."""
    return line.strip().lower()


def explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and distinct key, with the positions of its lines."""
    for batch in sliced(batches, 2000):
        k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: tuple[list, ...] = ([], [], [], [], [])
        for a, b, text in zip(k1, k2, texts_of(batch.column(2))):
            places: dict[bytes, list[int]] = {}
            for i, line in enumerate(text.split(b"\n")):
                if key := line_key(line):
                    places.setdefault(key, []).append(i)
            for key, where in places.items():
                digest = xxhash.xxh3_128_intdigest(key)
                row = (a, b, (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, where)
                for column, value in zip(out, row):
                    column.append(value)
        types = [pa.int64()] * 4 + [pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, types)], ["k1", "k2", "h1", "h2", "positions"]
        )


@F.pandas_udf(T.StringType())
def without_lines(texts: pd.Series, positions: pd.Series) -> pd.Series:
    def kept(text, drop):
        gone = set(drop)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    return pd.Series([t if p is None else kept(t, p) for t, p in zip(texts, positions)])


def drop_common_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with shortened texts, ``n_lines`` (before) and ``n_dropped``.

    Only hashes and positions are exchanged to find the lines; a common line is counted where it is
    read before anything is sent. The join that marks its lines can split a hot hash, as every row
    of it needs one bit only. Texts move once, to meet their positions.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    k1, k2 = row_key(doc_id, text)
    keys = scratch.save(
        docs.select(k1, k2, F.col(quoted(text))).mapInArrow(explode_keys, KEYS), "keys"
    )
    common = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    common = scratch.save(common.where(F.col("n") >= min_docs).select("h1", "h2"), "common")
    marked = (
        keys.join(common, ["h1", "h2"])
        .groupBy("k1", "k2")
        .agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"))
    )
    joined = packed(docs, k1=k1, k2=k2).join(marked, ["k1", "k2"], "left")
    old = F.coalesce(F.col(f"doc.{quoted(text)}"), F.lit(""))
    return unpacked(
        joined,
        docs.columns,
        **{text: F.when(F.col("positions").isNull(), old).otherwise(without_lines(old, "positions"))},
        n_lines=(F.length(old) - F.length(F.replace(old, F.lit("\n"))) + 1).cast("long"),
        n_dropped=F.coalesce(F.array_size("positions"), F.lit(0)).cast("long"),
    )
