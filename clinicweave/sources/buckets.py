"""Tables that are kept up to date by key: rows lie in hash buckets, and an update rewrites only the buckets it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables

BUCKET = "_bucket"  # the folder level that rows lie under


def _home(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias(BUCKET)


def write(df: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """`df` as a table under `path`, one folder for each bucket of `key`."""
    df.withColumn(BUCKET, _home(key, buckets)).repartition(buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(key, buckets)], "key string, buckets int").write.mode("overwrite").parquet(f"{path}/about")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table that `write` left under `path`."""
    return spark.read.parquet(f"{path}/rows").drop(BUCKET)


def settled(updates: DataFrame, key: str, latest_by: str | None) -> DataFrame:
    """One row for each key: the last by `latest_by`; without it, a repeated key is refused.

    Updates without a key are left out. Rows that tie in `latest_by` are settled by their other columns.
    """
    rows = updates.where(F.col(key).isNotNull())
    if latest_by is None:
        twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1").select(key).first()
        if twice is not None:
            raise ValueError(f"{key} {twice[0]} is updated more than once: state the column that orders updates")
        return rows
    order = Window.partitionBy(key).orderBy(F.col(latest_by).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in rows.columns if c not in (key, latest_by)))
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def merge(spark: SparkSession, path: str, updates: DataFrame, columns: list[str], latest_by: str | None = None) -> int:
    """Rows with an update get its values in `columns`; returns how many buckets were rewritten.

    Only buckets that hold an updated key are read and written, by dynamic partition overwrite; the
    files of all others stay as they are. Keys that the table lacks change nothing. The new buckets
    are written aside first, so that a lost job leaves the table as it was or can be repeated.
    """
    about = spark.read.parquet(f"{path}/about").first()
    key = about.key
    new = tables.stage(settled(updates, key, latest_by).select(key, *columns).withColumn(BUCKET, _home(key, about.buckets)), "updates")
    table = spark.read.parquet(f"{path}/rows")
    touched = new.join(table.select(BUCKET, key), [BUCKET, key], "left_semi").select(BUCKET).distinct()
    numbers = sorted(r[0] for r in touched.collect())  # `buckets` numbers at most
    if numbers:
        held = [F.col(f"`{c}`") for c in table.columns]
        old = table.where(F.col(BUCKET).isin(numbers)).alias("t")
        joined = old.join(new.withColumn("_hit", F.lit(True)).alias("u"), [F.col(f"t.{BUCKET}") == F.col(f"u.{BUCKET}"), F.col(f"t.{key}") == F.col(f"u.{key}")], "left")
        rows = joined.select(*(F.when(F.col("u._hit"), F.col(f"u.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c) if c in columns else F.col(f"t.`{c}`") for c in table.columns))
        aside = tables.stage(rows, "merged")
        aside.select(*held).repartition(len(numbers), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{path}/rows")
        tables.drop(aside)
    tables.drop(new)
    return len(numbers)
