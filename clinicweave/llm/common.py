"""Helpers that the training-data operators share: scratch tables, bounded broadcasts, free names, components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32_000_000  # what may be broadcast at most
BATCH_ROWS = 1000  # whole texts are wide: so many go to Python at a time
_OWN: dict[str, str] = {}
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a session on one machine may lack the setting (tests): a temporary folder stands in for it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="clinicweave-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def narrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches hold at most `rows` rows, which bounds the memory of Python workers and of the JVM beside them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def give_back(batches):
    """Pass batches on; memory that Arrow has freed goes back to the system once all are done."""
    yield from batches
    pa.default_memory_pool().release_unused()


def settle(spark: SparkSession) -> None:
    """Give back what finished work left in the driver, before more begins.

    Python drops unreachable tables, Arrow its free memory, and the JVM its garbage; with that, Spark's
    cleaner also takes away broadcasts and shuffles of tables that nothing holds any more.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _PATHS.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def reread(df: DataFrame) -> DataFrame:
    """A second, independent view of a written table, for joins with itself."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._scratch_path)
    out._scratch_path = df._scratch_path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what `write_table` wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _forget() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for path in _PATHS:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone before Python ends
        pass


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark `df` for broadcast when its counted `rows`, of `row_bytes` each, fit in `limit` bytes; else leave a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_columns(df: DataFrame, run, *more: tuple[str, T.DataType], left_out: int = 0) -> DataFrame:
    """`df` through `run`: it takes Arrow batches and gives lists of columns, the last `left_out` left out, those in `more` behind them.

    Names may be anything: they are set aside meanwhile, so `run` finds columns by their place.
    """
    kept = df.columns[: len(df.columns) - left_out]
    plain = [f"c{i}" for i in range(len(kept) + len(more))]
    kinds = [f.dataType for f in df.schema.fields[: len(kept)]] + [kind for _, kind in more]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(plain, kinds)])
    named = lambda batches: (pa.RecordBatch.from_arrays(columns, names=plain) for columns in run(batches))
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(lambda batches: give_back(named(batches)), schema).toDF(*kept, *(name for name, _ in more))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a long, b long): rows (v, c), c the smallest id reachable.

    Every vertex hooks onto its smallest neighbour, pointers are doubled until they are flat, and
    the graph is contracted; the number of rounds grows with the logarithm of a component's size.
    Vertices without an edge do not appear. No rows: an empty table.
    """
    spark = edges.sparkSession
    work = write_table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = None
    while not work.isEmpty():
        up = both(work).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p"))
        up = write_table(up.select("v", F.least("v", "p").alias("p")), "up")
        while True:
            top = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            flat = write_table(up.join(top, "p").select("v", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "up")
            done = flat.where("moved").isEmpty()
            drop_table(up)
            up = flat
            if done:
                break
        if labels is None:
            new = up.select("v", F.col("p").alias("c"))
        else:
            step = up.select(F.col("v").alias("c"), "p")
            new = labels.join(step, "c", "left").select("v", F.coalesce("p", "c").alias("c"))
        old, labels = labels, write_table(new, "labels")
        if old is not None:
            drop_table(old)
        a, b = up.select(F.col("v").alias("a"), F.col("p").alias("pa")), up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = work.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        done, work = work, write_table(left, "edges")
        drop_table(done)
        drop_table(up)
    drop_table(work)
    return labels if labels is not None else spark.createDataFrame([], "v long, c long")
