"""Toxicity of texts: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learnt: words, and stems of four and five letters, that toxic rows of the bounded
sample use far more often than others. Features are its densities, its nearness to second-person
words, and rates of capitals, punctuation and obfuscated spellings. The rows that fit the trees take
their features from lexicons counted without their own fold, so that trees see what new texts show.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, free, map_columns, write_table
from .lexicon import Lexicon, featured, terms
from .quality import bounded_sample

FOLDS = 5


class Model:
    """The lexicon, the trees and the calibration; `prior` answers alone without both labels."""

    def __init__(self, prior: float, lexicon: Lexicon | None = None, trees: GBTClassificationModel | None = None, calibration=None):
        self.prior, self.lexicon, self.trees, self.calibration = prior, lexicon, trees, calibration


def _features(docs: DataFrame, shared, text_col: str, out: str, fold_col: str | None = None) -> DataFrame:
    """`docs` with the vector `out`, from the lexicon of each row's fold, or the only one."""
    names = docs.columns
    run = featured(shared, names.index(text_col), names.index(fold_col) if fold_col else None)
    return map_columns(docs, run, (out, T.ArrayType(T.DoubleType()))).withColumn(out, array_to_vector(F.col(out)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = 8000, chars: int = 40_000_000, id_col: str = "doc_id", text_col: str = "text", trees: int = 20) -> Model:
    """A model from at most `rows` labelled texts of `chars` characters in all, as `bounded_sample` takes them.

    Four fifths fit the trees, the rest the calibration. The lexicon holds every word and stem that
    three rows of the sample use and toxic ones more often than others: its size, and what the driver
    and a broadcast hold, are bounded by the sample. An id counts once, whatever rows repeat it.
    Without both labels the model answers with the share of ones (0 if there are no rows).
    """
    sample = write_table(bounded_sample(docs, labels, label_col, rows, chars, id_col, text_col).withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int")), "toxic")
    sizes = {r.fold: (r.t, r.k) for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("k"), F.sum("label").alias("t")).collect()}
    toxic, n = (sum(x[i] for x in sizes.values()) for i in (0, 1))
    if not toxic or toxic == n:
        return Model(toxic / n if n else 0.0)
    counts = sample.select("text", "label", "fold").mapInArrow(terms, "term string, label int, fold int").groupBy("term")
    of = lambda k, value: F.sum(F.when(F.col("fold") == k, value).otherwise(0)).cast("int")
    counts = counts.agg(F.sum("label").cast("int").alias("t"), F.count(F.lit(1)).cast("int").alias("k"), *(x for i in range(FOLDS) for x in (of(i, F.col("label")).alias(f"t{i}"), of(i, F.lit(1)).alias(f"k{i}"))))
    lift = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("k") - F.col("t") + 0.5) / (n - toxic + 1))
    kept = counts.where(F.col("k") >= 3).where(lift > 0).toArrow()  # columns, no more than words in the sample
    names, t, k = kept.column("term").to_pylist(), kept.column("t").to_numpy(), kept.column("k").to_numpy()
    lexicon = Lexicon.counted(names, t, k, toxic, n)
    apart = []
    for i in range(FOLDS):
        own_t, own_k = sizes.get(i, (0, 0))
        apart.append(Lexicon.counted(names, t - kept.column(f"t{i}").to_numpy(), k - kept.column(f"k{i}").to_numpy(), toxic - own_t, n - own_k))
    shared = docs.sparkSession.sparkContext.broadcast(apart)
    data = _features(sample, shared, "text", "x", "fold").select("id", "label", "x").coalesce(8)
    data = write_table(data.withColumn("held", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0).withColumn("y", F.col("label").cast("double")), "features")
    shared.destroy()
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=3, stepSize=0.3, maxBins=64, seed=7).fit(data.where("not held"))
    held = model.transform(data.where("held")).select("y", vector_to_array("probability")[1].alias("p"))
    if held.agg(F.countDistinct("y")).first()[0] < 2:
        held = model.transform(data).select("y", vector_to_array("probability")[1].alias("p"))
    # two rows of the usual share at the top: few calibration rows alone do not make a score certain
    held = held.withColumn("w", F.lit(1.0)).union(held.agg(F.lit(toxic / n), F.max("p"), F.lit(2.0)))
    out = Model(toxic / n, lexicon, model, IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w").fit(held))
    drop_table(sample)
    drop_table(data)
    return out


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a column `out` (0 to 1) for each whole text; a column of that name is replaced.

    Null, empty and blank texts are scored as texts without words. Equal texts have equal scores;
    rows that repeat and other columns stay, whatever their names. Empty tables stay empty.
    """
    docs = docs.drop(out)
    if model.trees is None:
        return docs.withColumn(out, F.lit(float(model.prior)))
    x, raw, p, kind, p1, fit = free(docs, "x", "raw", "p", "kind", "p1", "fit")
    shared = docs.sparkSession.sparkContext.broadcast([model.lexicon])  # bounded by the sample
    trees = model.trees.copy().setFeaturesCol(x).setRawPredictionCol(raw).setProbabilityCol(p).setPredictionCol(kind)
    made = trees.transform(_features(docs, shared, text_col, x)).withColumn(p1, vector_to_array(p)[1])
    made = model.calibration.copy().setFeaturesCol(p1).setPredictionCol(fit).transform(made)
    return made.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(fit)))).drop(x, raw, p, kind, p1, fit)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each whole text, as `with_score` gives it."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_score(slim, model).select("doc_id", "score")
