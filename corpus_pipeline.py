"""A training-corpus pipeline: classify, filter, deduplicate lines and documents, pack.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and is written as
Parquet before the next one reads it. All but the last return the columns of documents. Null, empty
and blank texts hold nothing that a filter could reject: they pass both, keep their rows through
both deduplications, and are packed as a lone end token or their few tokens. Texts of any length are
judged whole; rows that repeat are judged alike, and rows that repeat both id and text count as one
document; rows without an id are near copies like others. Empty tables give empty results, and extra
columns are carried through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicweave.llm import line_dedup, ngram_join, packing, quality, toxicity
from clinicweave.llm.common import free, narrow_batches, read, settle, write_table
from clinicweave.llm.queries import TOKENIZER, learnable

LOW_QUALITY, TOXIC = 0.5, 0.7
NEAR = {"num": 80, "den": 100, "words": 5}  # near copies share 80 % of their five-word shingles; op7's query has its own rule


def _blank() -> F.Column:
    return ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"\S")


def _begin(spark: SparkSession) -> None:
    """Bounded batches, and a driver without what the stage before left there."""
    narrow_batches(spark)
    settle(spark)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5, and those without words."""
    _begin(spark)
    (score,) = free(docs, "score")
    model = quality.train(docs, learnable(read(spark, sf_dir, "labels")))
    settle(spark)
    return quality.with_score(docs, model, out=score).where((F.col(score) >= LOW_QUALITY) | _blank()).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7, and those without words."""
    _begin(spark)
    (score,) = free(docs, "score")
    model = toxicity.train(docs, learnable(read(spark, sf_dir, "labels")))
    settle(spark)
    return toxicity.with_score(docs, model, out=score).where((F.col(score) < TOXIC) | _blank()).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds exactly or within one edit."""
    _begin(spark)
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, once if its row repeats; texts without words all stay."""
    _begin(spark)
    th, mark_id, mark_th, mark = free(docs, "th", "mark_id", "mark_th", "mark")
    told = write_table(ngram_join.groups(docs, **NEAR).select("doc_id", "th", "n_shingles", "first"), "groups")
    gone = told.where("not first").select("doc_id", "th", F.lit("gone").alias("mark")).distinct()
    again = told.where("first and n_shingles > 0").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id", "th", F.lit("again"))
    marks = write_table(gone.union(again), "marks").toDF(mark_id, mark_th, mark)
    keyed = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(mark_id)) & (F.col(th) == F.col(mark_th))
    marked = keyed.join(marks, same, "left")  # by shuffle: copies grow with the documents
    left = marked.where(F.col(mark).isNull())
    if not marks.where(F.col(mark) == "again").isEmpty():
        left = left.union(marked.where(F.col(mark) == "again").dropDuplicates([mark_id, th]))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in windows of 2048 tokens."""
    _begin(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("lines", dedup_lines), ("documents", dedup_documents), ("packing", pack)]
ORACLE_SQL = None  # learnt models and tokens are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
