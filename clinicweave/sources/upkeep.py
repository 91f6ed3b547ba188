"""An enriched table that is kept: only what changed input files lead to is built again.

Input files are dealt into parts by a hash of their names. A manifest lists, for each file, its size
and time, and the fingerprint of the vocabularies it was built with. A part whose files or fingerprint
differ from the manifest is built from its files alone and replaces the old part. The manifest
forgets a part before its rows are touched and learns it after they are complete, and readers see
parts of the manifest only, so that a half-written part is never used.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from . import tables

PART = "_part"
_MANIFEST = "file string, size long, time timestamp, part int, fingerprint string"


def fingerprint(*more) -> str:
    """What an enriched row depends on besides its source: all vocabularies, lists and aliases, and `more`."""
    own = {k: v for k, v in vars(vocab).items() if k.isupper()}
    return hashlib.sha256(json.dumps([own, more], sort_keys=True, default=str).encode()).hexdigest()


def files(spark: SparkSession, source: str, parts: int) -> DataFrame:
    """(file, size, time, part) of the input files; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("time"), F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int").alias("part"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """What is complete under `path`; nothing where there is none."""
    if not tables.exists(spark, f"{path}/manifest/_SUCCESS"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def _write_manifest(rows: DataFrame, path: str) -> None:
    aside = tables.stage(rows, "manifest")  # it may be read from where it goes to
    aside.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")  # a row for each file
    tables.drop(aside)


def refresh(spark: SparkSession, source: str, path: str, read: Callable[[list[str]], DataFrame], build: Callable[[DataFrame], DataFrame], mark: str, parts: int = 64) -> list[int]:
    """Bring the table under `path` up to date with the files under `source`; the parts that were built.

    `read` takes file names, `build` makes enriched rows of what it returns, `mark` is the fingerprint
    of all that `build` depends on.
    """
    now = tables.stage(files(spark, source, parts).withColumn("fingerprint", F.lit(mark)), "files")
    known = manifest(spark, path)
    keys = ["file", "size", "time", "part", "fingerprint"]
    changed = now.join(known, keys, "left_anti").select("part").union(known.join(now, keys, "left_anti").select("part")).distinct()
    touched = sorted(r.part for r in changed.collect())  # `parts` numbers at most
    if touched:
        _write_manifest(known.where(~F.col("part").isin(touched)), path)
        todo = now.where(F.col("part").isin(touched)).groupBy("part").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("part").collect()  # names of files
        for part in touched:  # the manifest has forgotten them
            tables.remove(spark, f"{path}/rows/{PART}={part}")
        for r in todo:
            build(read(list(r.files))).withColumn(PART, F.lit(r.part)).write.mode("append").partitionBy(PART).parquet(f"{path}/rows")
        _write_manifest(manifest(spark, path).union(now.where(F.col("part").isin(touched)).select(*manifest(spark, path).columns)), path)
    tables.drop(now)
    return touched


def kept(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of complete parts; None where there are none."""
    whole = sorted(r.part for r in manifest(spark, path).select("part").distinct().collect())  # a number for each part
    if not whole or not tables.exists(spark, f"{path}/rows"):
        return None
    return spark.read.parquet(f"{path}/rows").where(F.col(PART).isin(whole)).drop(PART)
