"""Reading, resolving and writing facility tables; tables that jobs keep for a while."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vocab


BROADCAST_BYTES = 32_000_000  # what may be broadcast at most
_STAGED: list[str] = []


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, `spark.checkpoint.dir`, that goes when Python ends; a session on one machine may lack the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clinicweave-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def again(df: DataFrame) -> DataFrame:
    """A second, independent view of a staged table, for joins with itself."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._staged)
    out._staged = df._staged
    return out


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        remove(df.sparkSession, df._staged)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _forget() -> None:
    """What is still staged when Python ends goes."""
    spark = SparkSession.getActiveSession()
    try:
        for path in _STAGED if spark else ():
            remove(spark, path)
    except Exception:  # the JVM may be gone before Python ends
        return


def fits(df: DataFrame, row_bytes: int) -> Callable[[DataFrame], DataFrame]:
    """`broadcast` for tables of no more rows than `df`, if these fit in BROADCAST_BYTES; else what leaves them to a shuffle."""
    return F.broadcast if df.count() * row_bytes <= BROADCAST_BYTES else lambda x: x


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to all cores, whatever files they lie in: for rows that each become many."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    """A facility CSV with every column as text; only an empty value is null."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').option("nullValue", "").csv(path)


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]] = vocab.COLUMN_ALIASES, more: list[str] = ()) -> DataFrame:
    """Canonical columns, each from the first alias present; absent: empty text or null number. Columns in `more` come along."""
    found = {c.strip().lower(): c for c in reversed(df.columns)}
    out = []
    for name, names in aliases.items():
        source = next((found[a] for a in names if a in found), None)
        if name in ("latitude", "longitude"):
            out.append((F.expr(f"try_cast(`{source}` as double)") if source else F.lit(None).cast("double")).alias(name))
        else:
            value = text.strip(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))) if source else F.lit("")
            out.append((text.flatten_json_list(value) if name in vocab.LISTS else text.clean_pin(value) if name == "pin_code" else value).alias(name))
    keep = [F.col("hospital_id")] if "hospital_id" in df.columns else []
    return df.select(*keep, *out, *more)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows that say anything in name, specialties, notes, equipment, procedure or capability."""
    some = F.lit(False)
    for c in ("hospital_name", "specialties", "notes", "equipment", "procedure", "capability"):
        some = some | (F.col(c) != "")
    return df.where(some)


def assign_ids(df: DataFrame, order_by: list[str], id_col: str = "hospital_id") -> DataFrame:
    """Dense ids from 0 in `order_by` order.

    A range sort is written once with each row's partition and place; the partitions' counts become
    offsets, a row for each. No single window over the rows, no Python.
    """
    part, at, before = (_free(df, x) for x in ("part", "at", "before"))
    number = F.monotonically_increasing_id()  # the partition's number above 33 bits of places in it
    rows = stage(df.orderBy(*order_by).withColumn(at, number).withColumns({part: F.shiftright(at, 33), at: F.col(at).bitwiseAND(F.lit(2**33 - 1))}), "ordered")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("k"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select(F.col(part).alias(before), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k"))
    k = _free(df, "k")
    offsets = offsets.withColumnRenamed("k", k)
    out = rows.join(F.broadcast(offsets), F.col(part) == F.col(before)).withColumn(id_col, F.col(k) + F.col(at))
    return out.select(*(F.col(f"`{c}`") for c in [*(c for c in df.columns if c != id_col), id_col]))


def _free(df: DataFrame, name: str) -> str:
    """The name, with underscores before it that keep it apart from the columns of `df`."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def read_pins(spark: SparkSession, path: str) -> DataFrame:
    return clean_pins(spark.read.option("header", True).csv(path))


def clean_pins(pins: DataFrame) -> DataFrame:
    """Codes of six digits and coordinates; rows without coordinates go."""
    pin = text.strip(F.col("pin_code").cast("string"))
    return pins.select(
        F.when(F.length(pin) < 6, F.lpad(pin, 6, "0")).otherwise(pin).alias("pin_code"), text.strip("state").alias("state"), text.strip("district").alias("district"),
        F.expr("try_cast(latitude as double)").alias("latitude"), F.expr("try_cast(longitude as double)").alias("longitude"),
    ).dropna(subset=["latitude", "longitude"])


def write_index(df: DataFrame, path: str, by: str = "state_norm") -> None:
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ingest_bronze(df: DataFrame, name_col: str = "hospital_name") -> DataFrame:
    """The time of reading, and an id that hashes the name."""
    return df.withColumn("facility_id", F.sha2(F.col(name_col), 256)).withColumn("_ingest_ts", F.current_timestamp())


def geo_records(df: DataFrame) -> DataFrame:
    """Rows with a centroid, one JSON record each."""
    return df.where("latitude is not null and longitude is not null").select(F.to_json(F.struct(*df.columns)).alias("record"))


def export_geo(df: DataFrame, path: str) -> None:
    geo_records(df).write.mode("overwrite").text(path)
