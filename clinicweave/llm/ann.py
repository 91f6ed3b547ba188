"""Maximum-inner-product search with score-aware (anisotropic) four-bit quantisation.

A vector is stored as its coarse centre, the length of its residual, and four-bit codes of the
residual's direction, one per pair of dimensions. Codes minimise a loss in which error parallel to
the vector costs `eta` times error across it, since that is what moves large inner products. Every
row is coded, in blocks of bounded size; groups of queries meet blocks, scan their codes through
tables of 16 entries a code, and the best of each block are ranked again exactly, in double
precision, on the vectors as they are stored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

SUB, CODES = 2, 16


class Quantiser:
    """Coarse centres and code books, trained with numpy on a bounded sample."""

    def __init__(self, sample: np.ndarray, centres: int = 64, threshold: float = 0.2, rounds: int = 6, seed: int = 0):
        rng = np.random.default_rng(seed)
        n, d = sample.shape
        self.dim = d
        self.pad = -d % SUB
        self.eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        self.centres = sample[rng.choice(n, min(centres, n), replace=False)].copy()
        for _ in range(rounds):
            near = self._nearest(sample)
            for k in range(len(self.centres)):
                if (near == k).any():
                    self.centres[k] = sample[near == k].mean(axis=0)
        coarse, scale, unit, along = self._split(sample)
        m = unit.shape[1]
        self.books = np.stack([unit[rng.choice(n, CODES, replace=n < CODES), j] for j in range(m)])
        for _ in range(rounds):
            codes = self._assign(unit, along, passes=1)
            self._refit(unit, along, codes)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - 0.5 * (self.centres**2).sum(axis=1)).argmax(axis=1)

    def _split(self, x: np.ndarray):
        coarse = self._nearest(x)
        rest = x - self.centres[coarse]
        scale = np.linalg.norm(rest, axis=1)
        wide = lambda a, by: np.pad(a / np.where(by > 0, by, 1)[:, None], ((0, 0), (0, self.pad))).reshape(len(x), -1, SUB)
        return coarse, scale, wide(rest, scale), wide(x, np.linalg.norm(x, axis=1))

    def _assign(self, unit: np.ndarray, along: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent on across-error + eta * parallel-error."""
        n, m, _ = unit.shape
        cost = ((unit[:, :, None, :] - self.books[None]) ** 2).sum(-1)
        par = ((unit[:, :, None, :] - self.books[None]) * along[:, :, None, :]).sum(-1)
        codes = cost.argmin(axis=2)
        rows = np.arange(n)
        total = np.take_along_axis(par, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(passes):
            for j in range(m):
                others = total - par[rows, j, codes[:, j]]
                codes[:, j] = (cost[:, j] + (self.eta - 1) * (others[:, None] + par[:, j]) ** 2).argmin(axis=1)
                total = others + par[rows, j, codes[:, j]]
        return codes.astype(np.uint8)

    def _refit(self, unit: np.ndarray, along: np.ndarray, codes: np.ndarray) -> None:
        n, m, _ = unit.shape
        rows = np.arange(n)
        par = ((unit - self.books[np.arange(m), codes]) * along).sum(-1)
        total = par.sum(axis=1)
        for j in range(m):
            x, w = unit[:, j], along[:, j]
            others = total - par[:, j]
            a = np.eye(SUB)[None] + (self.eta - 1) * w[:, :, None] * w[:, None, :]
            b = x + (self.eta - 1) * w * (others + (x * w).sum(-1))[:, None]
            left, right = np.zeros((CODES, SUB, SUB)), np.zeros((CODES, SUB))
            np.add.at(left, codes[:, j], a)
            np.add.at(right, codes[:, j], b)
            used = np.bincount(codes[:, j], minlength=CODES) > 0
            self.books[j, used] = np.linalg.solve(left[used] + 1e-9 * np.eye(SUB), right[used][:, :, None])[:, :, 0]
            total = others + ((unit[:, j] - self.books[j, codes[rows, j]]) * w).sum(-1)

    def encode(self, x: np.ndarray):
        """(codes packed two to a byte, coarse centre, residual length) of each row."""
        out, where, scales = [], [], []
        for at in range(0, len(x), 1024):
            coarse, scale, unit, along = self._split(x[at : at + 1024])
            codes = self._assign(unit, along)
            if codes.shape[1] % 2:
                codes = np.pad(codes, ((0, 0), (0, 1)))
            out.append(codes[:, ::2] | (codes[:, 1::2] << 4))
            where.append(coarse.astype(np.int32))
            scales.append(scale.astype(np.float32))
        return np.concatenate(out), np.concatenate(where), np.concatenate(scales)

    def scan(self, queries: np.ndarray, packed: np.ndarray, coarse: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Approximate inner products, queries x rows, by table look-ups."""
        m = self.books.shape[0]
        parts = np.pad(queries, ((0, 0), (0, self.pad))).reshape(len(queries), m, SUB)
        tables = np.einsum("qms,mcs->mcq", parts, self.books).astype(np.float32)
        total = np.zeros((len(packed), len(queries)), np.float32)
        for j in range(m):
            total += tables[j][(packed[:, j // 2] >> (4 * (j % 2))) & 15]
        total *= scale[:, None]
        total += (self.centres @ queries.T).astype(np.float32)[coarse]
        return total.T


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` largest; of equal ones at the edge, those that come first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    over = np.flatnonzero(scores > edge)
    return np.concatenate([over, np.flatnonzero(scores == edge)[: k - len(over)]])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


_FOUND = "query_id long, q_block int, q_place int, vec_id long, score double"


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, rerank: int = 320, block: int = 16_384, group: int = 32_768, sample: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of each row whose id `every` divides.

    Vectors that are null, zero or hold null or non-finite components, and rows without an id, take
    no part. A row is no candidate of its own; others that repeat its id are, and each query row is
    answered. Vectors of several lengths are searched length by length, since vectors of different
    lengths have no inner product. Fewer candidates than `k`: all. Equal scores go to the smaller id.
    No usable vectors: no rows. Other columns are ignored. The quantiser of a length is fitted on at
    most `sample` rows, the first by a hash of the id; every row is coded and searched. Blocks are
    dealt by a hash of the rows, and `rerank` of about `block` are ranked exactly in each, so neither
    the number of cores nor the order of rows changes an answer.
    """
    rows = usable(vectors, id_col, vec_col)
    lengths = sorted(r.d for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1))).collect())
    found = [_search(rows.where(F.size("v") == d), d, every, k, rerank, block, group, sample) for d in lengths]
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found, none)


def _search(rows: DataFrame, dim: int, every: int, k: int, rerank: int, block: int, group: int, sample: int) -> DataFrame:
    spark = rows.sparkSession
    n = rows.count()
    share = int(min(1.0, 1.2 * sample / n) * 1_000_000) + 1
    few = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share)
    few = few if n <= sample or not few.isEmpty() else rows
    chosen = few.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).select("v").limit(sample).toArrow()  # the same whatever the order of rows
    flat = lambda column: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    model = spark.sparkContext.broadcast(Quantiser(flat(chosen.column("v"))))  # centres and code books: a few numbers for each dimension
    blocks = -(-n // block)

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by([("vec_id", "ascending"), ("h", "ascending")])
        x = flat(part.column("v"))
        codes, coarse, scale = model.value.encode(x)
        return pa.table({
            "block": pa.array([part.column("block")[0].as_py()], pa.int32()), "ids": [part.column("vec_id").to_numpy().astype("<i8").tobytes()], "raw": [x.astype("<f8").tobytes()],
            "codes": [codes.tobytes()], "coarse": [coarse.astype("<i4").tobytes()], "scale": [scale.astype("<f4").tobytes()],
        })

    def pick(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = np.frombuffer(row["ids"], "<i8")
                at = np.flatnonzero(ids % every == 0)
                raw = np.frombuffer(row["raw"], "<f8").reshape(-1, dim)[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), row["block"], np.int32)), pa.array(at.astype(np.int32)), pa.array([x.tobytes() for x in raw], pa.binary())], names=["query_id", "q_block", "q_place", "q"])

    dealt = rows.withColumn("h", F.xxhash64("v")).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    data = write_table(dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, raw binary, codes binary, coarse binary, scale binary"), "codes")
    asks = write_table(data.select("block", "ids", "raw").mapInArrow(pick, "query_id long, q_block int, q_place int, q binary"), "asks")
    parts = -(-asks.count() // group) or 1
    asks = asks.withColumn("part", F.pmod(F.xxhash64("query_id", "q_block", "q_place"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shared = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def scan(part: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0))]
        for row in part.to_pylist() if asked.num_rows else ():
            ids, raw = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["raw"], "<f8").reshape(-1, dim)
            codes, coarse, scale = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["coarse"], "<i4"), np.frombuffer(row["scale"], "<f4")
            step = max(1, 2_000_000 // len(ids))
            for at in range(0, asked.num_rows, step):
                some = asked.slice(at, step)
                queries = np.frombuffer(b"".join(some.column("q").to_pylist()), "<f8").reshape(-1, dim)
                rough = model.value.scan(queries, codes, coarse, scale)
                for q_id, home, place, q, r in zip(*(some.column(c).to_pylist() for c in ("query_id", "q_block", "q_place")), queries, rough):
                    best = top(r, rerank + 1)
                    if home == row["block"]:
                        best = best[best != place]
                    best = np.sort(best)
                    exact = np.cumsum(raw[best] * q, axis=1)[:, -1]  # in order of dimensions, whatever the row's place
                    order = np.lexsort((ids[best], -exact))[:k]
                    m = len(order)
                    out.append((np.full(m, q_id, np.int64), np.full(m, home, np.int32), np.full(m, place, np.int32), ids[best][order], exact[order]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "q_block", "q_place", "vec_id", "score"])

    met = shared.groupBy("block", "part").cogroup(asks.groupBy("block", "part")).applyInArrow(scan, _FOUND)
    order = Window.partitionBy("query_id", "q_block", "q_place").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
