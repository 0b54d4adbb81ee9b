"""Committed datasets of several splits: staged files, then one manifest that makes them current.

A write puts its files into a folder of its own and publishes them last, by renaming a manifest into
place. Until then, and for ever if the writer is killed, readers see the version before. The manifest
holds the schema, and for each split its rows and the sum of its rows' hashes, which do not depend on
order or partitioning and are checked on request.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textprep.schema import require_columns

MANIFESTS, VERSIONS = "_manifests", "versions"
DIGITS = 12


class DamagedDataset(ValueError):
    """The files of a version are not those its manifest describes."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _row_hash(df: DataFrame) -> Column:
    columns = sorted(c for c in df.columns if c != "split")
    return F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in columns]).cast("decimal(38,0)")


def checksums(df: DataFrame) -> dict[str, dict[str, str]]:
    """split -> rows and hash sum, in one pass; there is one row per split."""
    sums = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum(_row_hash(df)).alias("hash"))
    return {r["split"]: {"rows": r["rows"], "hash": str(r["hash"])} for r in sums.collect()}


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    fs, folder = _file_system(spark, path), _path(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit() and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    published = versions(spark, path)
    if not published or (version is not None and version not in published):
        raise FileNotFoundError(f"no version {version or ''} of a dataset at {path}".replace("  ", " "))
    number = published[-1] if version is None else version
    text = spark.read.text(f"{path}/{MANIFESTS}/{number:0{DIGITS}d}.json", wholetext=True).first()[0]
    return json.loads(text)


def stage(df: DataFrame, path: str) -> dict:
    """Write the files of a new version and return its manifest, which is not published yet."""
    spark = df.sparkSession
    folder = f"{VERSIONS}/{uuid.uuid4().hex}"
    require_columns(df, ["split"]).write.partitionBy("split").parquet(f"{path}/{folder}")
    schema = T.StructType([f for f in df.schema if f.name != "split"] + [T.StructField("split", T.StringType())])
    written = spark.read.schema(schema).parquet(f"{path}/{folder}")
    return {"folder": folder, "schema": schema.jsonValue(), "splits": checksums(written)}


def publish(spark: SparkSession, path: str, staged: Mapping) -> int:
    """Make a staged version the current one; returns its number.

    The manifest is written aside and renamed. If another writer has taken the number meanwhile, the
    rename fails and the next number is tried: no version is lost or overwritten.
    """
    fs = _file_system(spark, path)
    fs.mkdirs(_path(spark, f"{path}/{MANIFESTS}"))
    aside = _path(spark, f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(json.dumps(dict(staged)).encode()))
    stream.close()
    number = (versions(spark, path) or [0])[-1] + 1
    while True:
        target = _path(spark, f"{path}/{MANIFESTS}/{number:0{DIGITS}d}.json")
        if not fs.exists(target) and fs.rename(aside, target):
            return number
        number += 1


def write_dataset(df: DataFrame, path: str) -> int:
    """Write the splits of ``df`` as the next version and publish it."""
    return publish(df.sparkSession, path, stage(df, path))


def read_dataset(
    spark: SparkSession, path: str, split: str | None = None, version: int | None = None, verify: bool = False
) -> DataFrame:
    """A published version, the latest unless one is named; ``verify`` checks it against its manifest."""
    info = manifest(spark, path, version)
    schema = T.StructType.fromJson(info["schema"])
    df = spark.read.schema(schema).parquet(f"{path}/{info['folder']}")
    if verify and (found := checksums(df)) != info["splits"]:
        wrong = sorted({*found, *info["splits"]} - {s for s in found if found[s] == info["splits"].get(s)})
        raise DamagedDataset(f"{path}: splits {wrong} differ from the manifest")
    return df if split is None else df.where(F.col("split") == split)


def remove_unpublished(spark: SparkSession, path: str) -> list[str]:
    """Delete what killed writers left; only while no writer is at work. Returns the folders."""
    fs = _file_system(spark, path)
    kept = {manifest(spark, path, v)["folder"] for v in versions(spark, path)}
    folders = [f"{VERSIONS}/{s.getPath().getName()}" for s in fs.listStatus(_path(spark, f"{path}/{VERSIONS}"))]
    lost = sorted(set(folders) - kept)
    for folder in lost:
        fs.delete(_path(spark, f"{path}/{folder}"), True)
    return lost
