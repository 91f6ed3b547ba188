"""Exact top-k by inner product with bounds: blocks of similar rows, groups of similar queries.

Rows are laid out once by the nearest of a few pivots and their distance from it, and packed into
blocks that state a centre, a radius around it and their longest row; queries likewise into groups.
For a query q and a row x of a block, q·x is at most q·centre + |q| * radius, and at most |q| * longest;
the same holds for a group, whose queries are compared by their directions, since their lengths order nothing. Each group first scans the blocks most like it, as many as hold `k` rows:
a query's k-th score there bounds its k-th score from below. Pairs of a group and a block whose bound
lies below that of all its queries are never brought together. In a pair, queries are taken a few at
a time; a first part of the dimensions and the lengths of the rest decide which rows are multiplied
on. Bounds are widened by more than rounding can take, and scores are summed in the order of
dimensions, so that the result is that of comparing all, ties included.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import tables

SLACK = 1e-9  # of the product of two lengths: far more than sums in double precision lose
AT_ONCE = 256  # queries of a group that are taken together


@contextmanager
def batches_of(spark: SparkSession, size: str):
    """Arrow batches of about `size` at most for what runs inside: blocks are wide rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; a zero vector stays, with length one."""
    n = np.linalg.norm(x, axis=1)
    n[n == 0] = 1
    return x / n[:, None], n


def _place(pivots: np.ndarray, unit: bool):
    """Adds the nearest pivot of each row (or of its direction) and the distance from it."""

    def run(batches):
        half = 0.5 * (pivots * pivots).sum(axis=1)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = _matrix(part.column(1), pivots.shape[1])
                x = _unit(x)[0] if unit else x
                near = (x @ pivots.T - half).argmax(axis=1)
                far = np.linalg.norm(x - pivots[near], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(far)], names=["id", "vec", "cell", "far"])

    return run


def _pack(size: int, dim: int, unit: bool):
    """Blocks of up to `size` rows in their order, each of one cell; their bounds are those of directions if `unit`."""
    names = ["block", "n", "data", "centre", "radius", "longest", "lengths", "ids"]

    def block(number: int, ids: list, xs: list) -> pa.RecordBatch:
        x, held = np.concatenate(xs), pa.concat_arrays(ids)
        u, lengths = _unit(x) if unit else (x, np.ones(len(x)))
        centre = u.mean(axis=0)
        values = [
            pa.array([number], pa.int64()), pa.array([len(x)], pa.int32()), pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([centre.tolist()], pa.list_(pa.float64())),
            pa.array([float(np.linalg.norm(u - centre, axis=1).max())]), pa.array([float(np.linalg.norm(u, axis=1).max())]), pa.array([lengths.tolist()], pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
        ]
        return pa.RecordBatch.from_arrays(values, names=names)

    def run(batches):
        number, ids, xs, held, cell = TaskContext.get().partitionId() << 32, [], [], 0, None
        for batch in batches:
            cells, i = batch.column(2).to_numpy(), 0
            while i < batch.num_rows:
                if held and (cells[i] != cell or held == size):
                    yield block(number, ids, xs)
                    number, ids, xs, held = number + 1, [], [], 0
                cell = cells[i]
                part = batch.slice(i, min(int(np.searchsorted(cells[i:], cell, "right")), size - held))
                ids.append(part.column(0))
                xs.append(_matrix(part.column(1), dim))
                held += part.num_rows
                i += part.num_rows
        if held:
            yield block(number, ids, xs)

    return run


def packed(rows: DataFrame, pivots: np.ndarray, size: int, label: str, unit: bool = False) -> DataFrame:
    """A staged table of blocks (block, n, data, centre, radius, longest, lengths, ids) of rows (id, vec); with `unit`, by direction."""
    kind, dim = rows.schema["id"].dataType.simpleString(), pivots.shape[1]
    placed = rows.mapInArrow(_place(pivots, unit), f"id {kind}, vec array<double>, cell int, far double")
    parts = -(-rows.count() // size) or 1
    keys = ["cell", "far", F.xxhash64("id")]  # many equal rows are still dealt to several ranges
    ordered = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return tables.stage(ordered.mapInArrow(_pack(size, dim, unit), f"block long, n int, data binary, centre array<double>, radius double, longest double, lengths array<double>, ids array<{kind}>"), label)


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray):
    """(place of the query, places of rows, scores): each query's `k` best rows of those that reach its `least`.

    Equal scores go to the smaller id.
    """
    head = max(1, q.shape[1] // 4)
    lengths, tails = np.linalg.norm(x, axis=1), np.linalg.norm(x[:, head:], axis=1)
    longest = float(lengths.max(initial=0))
    for start in range(0, len(q), AT_ONCE):
        part = q[start : start + AT_ONCE]
        slack = SLACK * np.linalg.norm(part, axis=1) * longest
        floor = least[start : start + AT_ONCE] - slack
        rough = part[:, :head] @ x[:, :head].T
        if np.isfinite(floor).all():
            bound = rough + np.linalg.norm(part[:, head:], axis=1)[:, None] * tails[None]
            rows = np.flatnonzero((bound >= floor[:, None]).any(axis=0))
        else:
            rows = np.arange(len(x))
        if not len(rows):
            continue
        rough = rough[:, rows] + part[:, head:] @ x[rows, head:].T
        for j, score in enumerate(rough):
            some = np.flatnonzero(score >= floor[j])
            if len(some) > k:
                near = score[some]
                some = some[near >= np.partition(near, len(near) - k)[len(near) - k] - 2 * slack[j]]
            at = rows[some]
            exact = np.cumsum(x[at] * part[j], axis=1)[:, -1] if len(at) else np.empty(0)
            keep = exact >= least[start + j]
            at, exact = at[keep], exact[keep]
            order = np.lexsort((ids[at], -exact))[:k]
            yield start + j, at[order], exact[order]


def _scan(k: int, dim: int):
    """(grp, place, id, score) of pairs (grp, asked, least, data, ids) of a group's queries and a block."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                group, asked, floor, data, ids = (c[i] for c in batch.columns)
                q, x = (np.frombuffer(v.as_buffer(), "<f8").reshape(-1, dim) for v in (asked, data))
                least = floor.values.to_numpy(zero_copy_only=False) if floor.is_valid else np.full(len(q), -np.inf)
                names = ids.values
                for held in _gathered(best(q, x, names.to_numpy(zero_copy_only=False), k, least)):
                    place, at, score = held
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), group.as_py(), np.int64)), pa.array(place), names.take(pa.array(at)), pa.array(score)], names=["grp", "place", "id", "score"])

    return run


def _gathered(found, rows: int = 100_000):
    """Results put together until they are some thousands of rows."""
    held, size = [], 0
    for place, at, score in found:
        held.append((np.full(len(at), place, np.int32), at, score))
        size += len(at)
        if size >= rows:
            yield [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pairs(groups: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(grp, block, m, n, bound, lead): how large a product of the two may be, and whether it is among the first to be scanned.

    Centres and lengths only, a row for each group and block.
    """
    g = groups.select(F.col("block").alias("grp"), F.col("n").alias("m"), F.col("centre").alias("gc"), F.col("radius").alias("gr"), F.col("longest").alias("gl"))
    b = blocks.select("block", "n", F.col("centre").alias("bc"), F.col("radius").alias("br"), F.col("longest").alias("bl"))
    b = tables.fits(blocks, 700)(b)  # a row for thousands of vectors
    both = g.crossJoin(b).withColumn("dot", _dot("gc", "bc"))
    wide = F.col("dot") + F.col("gr") * F.sqrt(_dot("bc", "bc")) + F.col("br") * F.sqrt(_dot("gc", "gc")) + F.col("gr") * F.col("br")
    both = both.withColumn("bound", F.least(wide, F.col("gl") * F.col("bl")) + SLACK * F.col("gl") * F.col("bl"))
    before = Window.partitionBy("grp").orderBy(F.desc("dot"), "block").rowsBetween(Window.unboundedPreceding, -1)
    return both.select("grp", "block", "m", "n", "bound", (F.coalesce(F.sum("n").over(before), F.lit(0)) < k).alias("lead"))


def _dimension(df: DataFrame) -> int:
    row = df.where(F.size("vec") > 0).select(F.size("vec").alias("d")).first()
    return row.d if row else 0


def search(queries: DataFrame, vecs: DataFrame, k: int, query_block: int, row_block: int, cells: int = 64) -> tuple[DataFrame, DataFrame]:
    """Found (query, id, score, rank), and the pairs of `pairs` with `kind`: lead, met or skipped.

    queries (query, vec) and vecs (id, vec); rows whose vectors are null, hold nulls or are of another
    length than the queries' take no part. Queries that repeat are each answered.
    """
    spark = queries.sparkSession
    dim = _dimension(queries)
    whole = lambda df: df.where((F.size("vec") == dim) & ~F.exists("vec", lambda e: e.isNull()))
    kinds = queries.schema["query"].dataType.simpleString(), vecs.schema["id"].dataType.simpleString()
    rows = whole(vecs.select("id", F.col("vec").cast("array<double>").alias("vec")))
    pivots = [r.vec for r in rows.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(cells).collect()]  # they shape the blocks, not the result
    if not dim or not pivots:
        none = spark.createDataFrame([], f"query {kinds[0]}, id {kinds[1]}, score double, rank int")
        return none, spark.createDataFrame([], "grp long, block long, m int, n int, bound double, lead boolean, kind string")
    pivots = np.unique(np.array(pivots), axis=0)
    blocks = packed(rows, pivots, row_block, "blocks")
    groups = packed(whole(queries.select(F.col("query").alias("id"), F.col("vec").cast("array<double>").alias("vec"))), _unit(pivots)[0], query_block, "groups", unit=True)
    near = tables.stage(pairs(groups, blocks, k), "pairs")

    def scanned(some: DataFrame, label: str) -> DataFrame:
        asked = tables.again(groups).select(F.col("block").alias("grp"), F.col("data").alias("asked"))
        met = some.join(asked, "grp").join(tables.again(blocks).select("block", "data", "ids"), "block").select("grp", "asked", "least", "data", "ids")
        with batches_of(spark, "48m"):
            return tables.stage(met.mapInArrow(_scan(k, dim), f"grp long, place int, id {kinds[1]}, score double"), label)

    order = Window.partitionBy("grp", "place").orderBy(F.desc("score"), "id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = tables.stage(ranked(scanned(near.where("lead").withColumn("least", F.lit(None).cast("array<double>")), "first")), "lead")
    # a query's k-th score so far; without k rows, anything may still belong to it
    kth = first.groupBy("grp", "place").agg(F.coalesce(F.max(F.when(F.col("rank") == k, F.col("score"))), F.lit(float("-inf"))).alias("least"))
    least = kth.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "least"))), lambda x: x["least"]).alias("least"))  # a group's queries
    lengths = tables.again(groups).select(F.col("block").alias("grp"), "lengths")  # products with directions are what bounds hold for
    held = tables.stage(least.join(lengths, "grp").select("grp", "least", F.array_min(F.zip_with("least", "lengths", lambda a, b: a / b)).alias("low")), "least")
    rest = tables.again(near).where("not lead").join(held, "grp").where("bound >= low").select("grp", "block", "least")
    more = scanned(rest, "rest")
    found = ranked(first.drop("rank").union(more))
    names = tables.again(groups).select(F.col("block").alias("grp"), F.posexplode("ids").alias("place", "query"))
    found = tables.stage(found.join(names, ["grp", "place"]).select("query", "id", "score", "rank"), "found")
    kind = F.when(F.col("lead"), "lead").when(F.col("bound") >= F.col("low"), "met").otherwise("skipped")
    told = tables.stage(tables.again(near).join(held.select("grp", "low"), "grp").select("grp", "block", "m", "n", "bound", "lead", kind.alias("kind")), "told")
    tables.drop(blocks, groups, near, first, held, more)
    return found, told


def scan(queries: DataFrame, vecs: DataFrame, k: int) -> DataFrame:
    """What `search` finds, for AT_ONCE queries at most: they go to where the vectors lie, of which each task sends `k` a query."""
    spark = queries.sparkSession
    dim, kinds = _dimension(queries), (queries.schema["query"].dataType.simpleString(), vecs.schema["id"].dataType.simpleString())
    whole = lambda df: df.where((F.size("vec") == dim) & ~F.exists("vec", lambda e: e.isNull()))
    asked = whole(queries.select("query", F.col("vec").cast("array<double>").alias("vec"))).limit(AT_ONCE + 1).collect()
    if len(asked) > AT_ONCE:
        raise ValueError(f"scan takes {AT_ONCE} queries at most")
    if not dim or not asked:
        return spark.createDataFrame([], f"query {kinds[0]}, id {kinds[1]}, score double, rank int")
    shared = spark.sparkContext.broadcast(np.array([r.vec for r in asked], np.float64))

    def run(batches):
        q = shared.value
        held, least = [[] for _ in q], np.full(len(q), -np.inf)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                for place, at, score in best(q, _matrix(part.column(1), dim), ids, k, least):
                    if len(at):
                        names, scores = (np.concatenate(x) for x in zip(*held[place], (ids[at], score)))
                        order = np.lexsort((names, -scores))[:k]
                        held[place] = [(names[order], scores[order])]
                        least[place] = scores[order[-1]] if len(order) == k else -np.inf
        for place, found in enumerate(held):
            for names, scores in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), place, np.int32)), pa.array(names, kind), pa.array(scores)], names=["place", "id", "score"])

    rows = whole(vecs.select("id", F.col("vec").cast("array<double>").alias("vec")))
    kind = to_arrow_type(rows.schema["id"].dataType)
    order = Window.partitionBy("place").orderBy(F.desc("score"), "id")
    found = rows.mapInArrow(run, f"place int, id {kinds[1]}, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["query"]) for i, r in enumerate(asked)], f"place int, query {kinds[0]}")
    return tables.stage(found.join(F.broadcast(names), "place").select("query", "id", "score", "rank"), "found")
