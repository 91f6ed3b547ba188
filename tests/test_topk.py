"""Exact top-k with bounds against comparing all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinicweave.operators import topk, vectors


def brute(q, x, k):
    s = np.array([[np.cumsum(a * b)[-1] for b in x] for a in q])
    return {i: [(n + 1, int(j), float(s[i, j])) for n, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:k])] for i in range(len(q))}


def answers(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.query, []).append((r.rank, r.id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = 4 * rng.normal(size=(6, 8))
    return centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, 8))


@pytest.mark.parametrize("kind", ["clustered", "lengths", "copies", "noise"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    x = {"clustered": clustered(600), "lengths": rng.normal(size=(500, 5)) * rng.lognormal(0, 2, 500)[:, None], "copies": np.repeat(clustered(40, 2), 12, axis=0), "noise": rng.normal(size=(300, 6))}[kind]
    x[3] = 0
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    asked = vecs.where("id % 7 = 0").withColumnRenamed("id", "query")
    found, told = topk.search(asked, vecs, 9, 10, 25, cells=8)
    want = brute(x[::7], x, 9)
    assert answers(found) == {7 * i: v for i, v in want.items()}
    kinds = {r.kind: r.k for r in told.groupBy("kind").agg(F.sum(F.col("m") * F.col("n")).alias("k")).collect()}
    assert sum(kinds.values()) == len(x) * len(x[::7])
    if kind in ("clustered", "lengths"):
        assert kinds["skipped"] > 0.4 * sum(kinds.values())


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0])]
    vecs = spark.createDataFrame(rows, "id int, vec array<float>")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "query string, vec array<double>")
    got = sorted((r.query, r.rank, r.id, r.score) for r in vectors.vector_topk(asked, vecs, 10).collect())
    assert got == sorted([("a", 1, 1, 1.0), ("a", 2, 6, 1.0), ("a", 3, 6, 1.0), ("a", 4, 2, 0.0)] * 2 + [("b", 1, 2, 2.0), ("b", 2, 6, 2.0), ("b", 3, 6, 2.0), ("b", 4, 1, 0.0)])
    assert vectors.vector_topk(asked, vecs.where("false"), 10).count() == 0 and vectors.vector_topk(asked.where("false"), vecs, 10).count() == 0


def test_equal_rows_are_dealt_to_several_blocks(spark):
    vecs = spark.range(1000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    blocks = topk.packed(vecs, np.array([[1.0, 2.0]]), 50, "blocks")
    assert blocks.agg(F.max("n"), F.sum("n")).first()[0] <= 50 and blocks.agg(F.sum("n")).first()[0] == 1000
    got = answers(vectors.vector_topk(vecs.where("id = 5").withColumnRenamed("id", "query"), vecs, 3, 50, 50))
    assert got == {5: [(1, 0, 5.0), (2, 1, 5.0), (3, 2, 5.0)]}
