"""Folders of facility files whose headers differ: each file is resolved by its own header, malformed rows are kept apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab
from . import tables

_BROKEN = "_broken_record"
_CSV = {"header": True, "multiLine": True, "escape": '"', "nullValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN, "enforceSchema": True}


def headers(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(header line, files) for each different first line of the files under `path`; empty files are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("at"))
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()  # names of files
    return [(r.header, list(r.files)) for r in found]


def _columns(spark: SparkSession, header: str) -> list[str]:
    """Names in a header line; a repeated or empty one is told apart by its place."""
    fields = spark.createDataFrame([(header.lstrip("﻿"),)], "h string").select(F.from_csv("h", F.lit(", ".join(f"c{i} string" for i in range(header.count(",") + 1))), {"escape": '"'}).alias("c")).first().c
    names, out = [str(x).strip() if x is not None else "" for x in fields], []
    while names and not names[-1] and header.count('"'):
        names.pop()  # commas inside quotes are no borders
    for i, name in enumerate(names):
        out.append(name if name and name.lower() not in {x.lower() for x in out} else f"_{i}_{name}")
    return out


def read_many(spark: SparkSession, path: str, aliases: dict[str, list[str]] = vocab.COLUMN_ALIASES) -> tuple[DataFrame, DataFrame]:
    """Canonical rows with their `source_file`, and malformed ones (source_file, record).

    Each file's columns are found by its own header, so files of one folder may differ in order, names
    and number of columns. A row with more or fewer fields than its header is malformed. Files are
    read together where their headers are equal.
    """
    good, broken = [], []
    for header, files in headers(spark, path):
        names = _columns(spark, header)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BROKEN]])
        rows = spark.read.schema(schema).options(**_CSV).csv(files).withColumn("source_file", F.col("_metadata.file_path"))
        rows = rows.select("source_file", *(F.col(f"`{n}`") for n in [*names, _BROKEN]))
        fine = rows.where(F.col(_BROKEN).isNull())
        resolved = tables.resolve_columns(fine.select(*(F.col(f"`{n}`") for n in names), F.col("source_file").alias("_source_file")), aliases, ["_source_file"])
        good.append(resolved.withColumnRenamed("_source_file", "source_file"))
        read = F.coalesce(F.length(f"`{names[0]}`"), F.lit(0)) >= 0  # a broken record cannot be read alone
        broken.append(rows.where(F.col(_BROKEN).isNotNull() & read).select("source_file", F.col(_BROKEN).alias("record")))
    if not good:
        raise ValueError(f"no file with a header under {path}")
    return reduce(DataFrame.unionByName, good), reduce(DataFrame.unionByName, broken)
