"""Text quality from supervised subword embeddings.

A document is the mean of hashed vectors of its words and of the character n-grams inside them; a
softmax over that mean gives the classes. Vectors and output are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. Since the output is linear in the mean, each
hashed bucket comes down to one number a class, which is what tasks look up when they score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns

BUCKETS, DIM, SIZES = 1 << 17, 12, (3, 4)
_K = np.uint64(0x9E3779B97F4A7C15)


def buckets(raw: bytes, count: int = BUCKETS) -> np.ndarray:
    """Buckets of the words of a UTF-8 text, of the n-grams of their bytes, ends marked, and of pairs of equal words.

    All pairs of a word and itself share one bucket: they mark texts that repeat words, whichever.
    """
    b = np.frombuffer(b" " + raw + b" ", np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    x = (np.where(space, 32, b).astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    shift = np.uint64(64 - count.bit_length() + 1)
    out = []
    h = np.zeros(len(b), np.uint64)
    n = len(b)
    before = np.concatenate([[0], np.cumsum(space)])
    for k in range(max(SIZES)):
        # n-grams that start at each byte, of k + 1 bytes
        h = h[: n - k] if k else h
        h = (h ^ x[k:]) * _K
        h ^= h >> np.uint64(32)
        if k + 1 in SIZES:
            inner = before[k:n] - before[1 : n - k + 1]  # spaces strictly inside
            out.append((h[inner == 0] * _K >> shift).astype(np.int64))
    edge = np.flatnonzero(space)
    starts, ends = edge[:-1] + 1, edge[1:]
    some = ends > starts
    if some.any():
        place = np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(x ^ (x >> np.uint64(17)), dtype=np.uint64)])
        mixed = np.concatenate([[np.uint64(0)], np.cumsum(x * place, dtype=np.uint64)])
        s, e = starts[some], ends[some]
        plain = total[e] - total[s]
        placed = mixed[e] - mixed[s] - (np.uint64(2) * s.astype(np.uint64)) * _sum(x, s, e)
        words = (plain ^ (placed * _K)) * _K
        out.append((words >> shift).astype(np.int64))
        out.append(np.full(int((words[1:] == words[:-1]).sum()), count - 1))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _sum(x: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
    return total[e] - total[s]


class Classifier:
    """Mean of hashed vectors and softmax; `weights` holds the difference of the two classes' logits."""

    def __init__(self, prior: float = 0.5):
        self.prior = prior
        self.weights: np.ndarray | None = None
        self.bias = 0.0

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, rate: float = 2.0, seed: int = 0) -> Classifier:
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
        share = labels.mean()
        cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
        steps, done = epochs * len(docs), 0
        for _ in range(epochs):
            for k in rng.permutation(len(docs)):
                at, part = docs[k]
                done += 1
                if not len(at):
                    continue
                hidden = part @ vectors[at]
                z = out @ hidden + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[k]] -= 1
                lift = part * len(at) ** 0.5
                bend = float(hidden @ hidden) + float(part @ lift) * float((out * out).sum())
                pace = rate * (1 - done / (steps + 1)) * cost[k]
                p *= pace / max(1.0, pace * bend)  # a step never overshoots its own loss
                step = out.T @ p
                out -= np.outer(p, hidden)
                bias -= 0.05 * p
                vectors[at] -= np.outer(lift, step)
        self.weights = vectors @ (out[1] - out[0])
        self.bias = float(bias[1] - bias[0])
        return self

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.prior
        at = buckets((text or "").encode("utf-8", "replace"))
        mean = float(self.weights[at].mean()) if len(at) else 0.0
        return float(1 / (1 + np.exp(-np.clip(mean + self.bias, -500, 500)))) if len(at) else self.prior


def _features(batches):
    """Distinct buckets of each labelled text and their shares."""
    for whole in batches:
        for start in range(0, whole.num_rows, 200):
            batch = whole.slice(start, 200)
            at, part = [], []
            for text in batch.column(0).to_pylist():
                found, counts = np.unique(buckets((text or "").encode("utf-8", "replace")), return_counts=True)
                at.append(found.astype(np.int32))
                part.append((counts / max(1, counts.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(part, pa.list_(pa.float32())), batch.column(1).cast(pa.int32())], names=["at", "part", "label"])


def bounded_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `rows` labelled texts of at most `chars` characters together: (id, text, label), by a hash of the id.

    An id that is labelled twice counts once, with the larger label; of rows that repeat an id, the
    one with the smallest hash of its text is taken. Ids are taken in order of their hash; texts longer
    than four times an even share of `chars` are left out, as are the last ones once `chars` are spent.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    place = [F.xxhash64("id"), F.col("id")]
    chosen = known.orderBy(*place).limit(rows)
    sizes = slim.select("id", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n")).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("h").alias("h"), F.min_by("n", "h").alias("n"))
    fitting = sizes.where(F.col("n") <= max(1, 4 * chars // rows))
    spent = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)  # `rows` rows of numbers at most
    kept = fitting.withColumn("spent", F.sum("n").over(spent)).where(F.col("spent") <= chars).select("id", "label", "h")
    return slim.withColumn("h", F.xxhash64("text")).join(F.broadcast(kept), ["id", "h"]).groupBy("id", "label").agg(F.first("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = 4000, chars: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """A classifier from at most `rows` labelled texts of `chars` characters in all, as `bounded_sample` takes them.

    Without both classes it answers with the share of ones (0.5 if there are none); null and empty
    texts count as texts without words. The driver gets one number pair for each distinct bucket of
    a text, so `chars` bounds what it holds.
    """
    sample = bounded_sample(docs, labels, label_col, rows, chars, id_col, text_col).orderBy("id")
    got = sample.select("text", "label").mapInArrow(_features, "at array<int>, part array<float>, label int").toArrow()
    label = got.column("label").to_numpy()
    prior = float(label.mean()) if len(label) else 0.5
    if not len(label) or label.min() == label.max():
        return Classifier(prior)
    each = lambda name: [x.values.to_numpy() for x in got.column(name)]
    return Classifier(prior).fit(list(zip(each("at"), each("part"))), label)  # views of what Arrow holds


def with_score(docs: DataFrame, model: Classifier, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a column `out` (0 to 1) for each whole text; a column of that name is replaced.

    Null, empty and blank texts get the training share. Equal texts have equal scores; rows that
    repeat and other columns stay as they are, whatever their names. Empty tables stay empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** 17 numbers at most
    docs = docs.drop(out)
    at_text = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                yield [*part.columns, pa.array([m.score(t) for t in part.column(at_text).to_pylist()], pa.float64())]

    return map_columns(docs, run, (out, T.DoubleType()))


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each whole text, as `with_score` gives it."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_score(slim, model).select("doc_id", "score")
