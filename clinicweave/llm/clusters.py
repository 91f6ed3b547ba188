"""Lloyd's clustering in exact integers by deltas.

Vectors are packed into blocks of a table that is bucketed by block and written once. The
assignments (a cluster and a squared distance for each vector) are a second table with the same
buckets, so that each round joins the two where they lie, without a shuffle. A round compares a
vector with the centroids that have changed since its last one only, unless its own is among them;
then with all. Vectors that change hands are summed up in each block as signed integers, out of one
cluster and into another; only these transfers are added to the global sums, from which the next
centroids come. When nothing moves, the later rounds would repeat it and are left out.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, give_back, shared_dir, write_table

BLOCK = 4096  # vectors of a block
_TABLES: list[tuple[SparkSession, str]] = []
_STATE = "block long, cluster binary, distance binary, moves array<struct<c: int, n: long, sums: array<long>>>, inertia array<long>"


def integers(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of `dim` components, none null or non-finite, as floor(scale * x)."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.where(v.isNotNull() & (F.size(v) == dim) & ~bad)
    most = 2**62 / scale  # beyond, a long cannot hold the integer
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double"))) * scale)).alias("v"))


def _flat(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pack(dim: int, limit: int):
    """Blocks (block, ids, known, x) of the rows of a task, in their order; `limit` bounds the integers' size."""

    def run(batches):
        task, at = TaskContext.get().partitionId(), 0
        ids, xs, held = [], [], 0

        def close():
            a, x = pa.concat_arrays(ids), np.concatenate(xs)
            if np.abs(x).max(initial=0) > limit:
                raise ValueError(f"components of more than {limit} in size: squared distances of {dim} of them do not fit in 64 bits")
            known = a.is_valid().to_numpy(zero_copy_only=False)
            one = lambda data: pa.array([data], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + at], pa.int64()), one(a.fill_null(0).to_numpy().astype("<i8").tobytes()), one(np.packbits(known).tobytes()), one(x.astype("<i4").tobytes())], names=["block", "ids", "known", "x"])

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                ids.append(part.column(0))
                xs.append(_flat(part.column(1), dim))
                held += part.num_rows
                if held >= BLOCK:
                    yield close()
                    ids, xs, held, at = [], [], 0, at + 1
        if held:
            yield close()

    return lambda batches: give_back(run(batches))


def bucketed(df: DataFrame, label: str, buckets: int) -> DataFrame:
    """`df` as a table in the shared folder, one file for each of `buckets` buckets of `block`."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.repartition(buckets, "block").write.bucketBy(buckets, "block").sortBy("block").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    _TABLES.append((spark, name))
    out = spark.table(name)
    out._scratch_path, out._table = f"{shared_dir(spark)}/{name}", name
    return out


def _drop(df: DataFrame) -> None:
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
    drop_table(df)


@atexit.register
def _forget() -> None:
    for spark, name in _TABLES:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone before Python ends
            return


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, vectors x centres, in 64-bit integers."""
    out = np.empty((len(x), len(centres)), np.int64)
    for k, c in enumerate(centres):
        gap = x - c
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def reassign(x: np.ndarray, own: np.ndarray, best: np.ndarray, centres: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centres and distances, the smaller number first among equals; `own` (-1: none yet) and `best` are those of the centres before."""
    own, best = own.copy(), best.copy()
    lost = np.flatnonzero((own < 0) | changed[np.maximum(own, 0)])
    if len(lost):  # their own centre has moved: all centres
        d = distances(x[lost], centres)
        own[lost] = d.argmin(axis=1)
        best[lost] = d[np.arange(len(lost)), own[lost]]
    moved = np.flatnonzero(changed)
    rest = np.setdiff1d(np.arange(len(x)), lost, assume_unique=True)
    if len(rest) and len(moved):  # the others can only be won by a centre that has moved
        d = distances(x[rest], centres[moved])
        at = d.argmin(axis=1)
        near = d[np.arange(len(rest)), at]
        won = (near < best[rest]) | ((near == best[rest]) & (moved[at] < own[rest]))
        own[rest[won]], best[rest[won]] = moved[at[won]], near[won]
    return own, best


def transfers(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> list[dict]:
    """Signed counts and component sums of the vectors that left or joined each cluster."""
    out = []
    went = np.flatnonzero(before != after)
    for c in range(k):
        to, off = went[after[went] == c], went[before[went] == c]
        if len(to) or len(off):
            out.append({"c": c, "n": len(to) - len(off), "sums": (x[to].sum(axis=0) - x[off].sum(axis=0)).tolist()})
    return out


def _round(dim: int, centres: np.ndarray, changed: np.ndarray):
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, data, cluster, distance = (c[i].as_py() for c in batch.columns)
                x = np.frombuffer(data, "<i4").reshape(-1, dim).astype(np.int64)
                own = np.frombuffer(cluster, "<i4").astype(np.int64) if cluster is not None else np.full(len(x), -1)
                best = np.frombuffer(distance, "<i8") if distance is not None else np.zeros(len(x), np.int64)
                now, near = reassign(x, own, best, centres, changed)
                inertia = [int(near[now == c].sum()) for c in range(len(centres))]
                row = [block, now.astype("<i4").tobytes(), near.astype("<i8").tobytes(), transfers(x, own, now, len(centres)), inertia]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["block", "cluster", "distance", "moves", "inertia"])

    return lambda batches: give_back(run(batches))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", bucket_rows: int = 32 * BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector.

    Kept are vectors of exactly `dim` components, none of them null or non-finite, as integers
    floor(scale * x). The first centroids are the `k` kept vectors whose sha256 of `seed:id` is
    smallest (all, if there are fewer; of rows that share an id, the smaller vector comes first; rows
    without an id come last). Each of `rounds` rounds assigns and then replaces every non-empty
    centroid by the floor of its mean; then vectors are assigned once more. Equal distances go to the
    smaller number; empty centroids stay. Rows that repeat are each answered; no kept vectors give no
    rows; other columns are ignored. Integers whose squared distances do not fit in 64 bits fail the job.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vec_col, dim, scale)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], schema)
    buckets = -(-rows.count() // bucket_rows)
    limit = int((2**63 / dim) ** 0.5) // 2 - 1
    points = bucketed(rows.mapInArrow(_pack(dim, min(limit, 2**31 - 1)), "block long, ids binary, known binary, x binary"), "points", buckets)

    centres = np.array([r.v for r in first], np.int64)
    sums, sizes = np.zeros((len(centres), dim), object), np.zeros(len(centres), object)  # exact beyond 64 bits
    changed, state = np.ones(len(centres), bool), None
    for done in range(rounds + 1):
        if state is None:
            met = points.select("block", "x", F.lit(None).cast("binary").alias("cluster"), F.lit(None).cast("binary").alias("distance"))
        else:
            met = points.select("block", "x").join(state.select("block", "cluster", "distance").hint("merge"), "block")
        new = bucketed(met.mapInArrow(_round(dim, centres, changed), _STATE), "owners", buckets)
        if state is not None:
            _drop(state)
        state = new
        if done == rounds:
            break
        moves = state.select(F.explode("moves").alias("m")).select("m.c", "m.n", F.posexplode("m.sums").alias("i", "s"))
        # a row for each cluster and dimension
        total = moves.groupBy("c", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.when(F.col("i") == 0, F.col("n")).otherwise(0)).alias("n")).collect()
        for r in total:
            sums[r.c, r.i] += int(r.s)
            sizes[r.c] += int(r.n)
        next_ = np.array([[int(s) // int(n) for s in row] if n else old.tolist() for row, n, old in zip(sums, sizes, centres)], np.int64)
        changed = (next_ != centres).any(axis=1)
        centres = next_
        if not changed.any():  # every later round repeats this one
            break
    inertia = {r.c: int(r.d) for r in state.select(F.posexplode("inertia").alias("c", "d")).groupBy("c").agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    each, whole = [inertia[c] for c in range(len(centres))], sum(inertia.values())

    def answer(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, known, own, near = (c[i].as_py() for c in batch.columns)
                a, c, d = np.frombuffer(ids, "<i8"), np.frombuffer(own, "<i4"), np.frombuffer(near, "<i8")
                gone = np.unpackbits(np.frombuffer(known, np.uint8))[: len(a)] == 0
                columns = [pa.array(a, pa.int64(), mask=gone), pa.array(c, pa.int32()), pa.array(d, pa.int64()), pa.array(np.array(each, np.int64)[c]), pa.array(np.full(len(a), whole, np.int64)), pa.array([names[j] for j in c.tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    found = points.select("block", "ids", "known").join(state.select("block", "cluster", "distance").hint("merge"), "block").select("ids", "known", "cluster", "distance")
    out = write_table(found.mapInArrow(answer, schema), "clusters")
    _drop(points)
    _drop(state)
    return out
