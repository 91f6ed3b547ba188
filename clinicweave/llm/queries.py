"""Registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, clusters, langid, line_dedup, media, ngram_join, packing, phrases, quality, simhash, toxicity, warc
from .common import narrow_batches, read, write_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _crc(column: F.Column) -> F.Column:
    return F.crc32(column.cast("string").cast("binary"))


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: the remainder of crc32 by 3 is not 1."""
    return labels.where(_crc(F.col("doc_id")) % 3 != 1)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a media file, read back: one row for each row of documents.

    Null and empty texts are 64 zeros; texts of any length are stored whole; ties do not arise; rows
    that repeat are each answered; an empty table gives no rows; other columns are not read.
    """
    narrow_batches(spark)
    stored = write_table(media.to_media(read(spark, sf_dir, "documents")), "media")
    return media.probe(stored)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text: one row for each row of documents.

    Null texts and those without a letter are `und` with score 0; texts of any length count whole; of
    equal entropies the first language by name wins; rows that repeat are each answered, and count
    each in training; an empty table gives no rows; of other columns only lang is read, for training.
    """
    narrow_batches(spark)
    docs = read(spark, sf_dir, "documents")
    held = _crc(F.col("doc_id")) % 4 == 2
    models = langid.train(docs.where(~F.coalesce(held, F.lit(True))).select("doc_id", "text", "lang"))
    found = langid.identify(docs, models)
    return found.select("doc_id", (_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text: one row for each row of documents.

    Null, empty and blank texts are scored as texts without words; texts of any length count whole;
    equal texts have equal scores; rows that repeat are each scored, and an id counts once in training;
    an empty table gives no rows, and without labels the score is the same for all; other columns are
    not read.
    """
    narrow_batches(spark)
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = _crc(F.col("doc_id")) % 3 == 1
    found = toxicity.score(docs, toxicity.train(docs, learnable(labels)))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that an earlier one holds: one row for each row of documents.

    Null texts stay null and have no lines; blank lines stay; texts and lines may be of any length;
    the earliest line stays, by id, hash of the text and line number, null ids first; rows that repeat
    id and text keep the same lines; an empty table gives no rows; other columns are not read.
    """
    narrow_batches(spark)
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return found.select("doc_id", F.col("n_lines"), F.col("n_removed"), F.col("text"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded: one row for each row of documents.

    Null and empty texts have no tokens; texts of any length are encoded whole; of equal pairs the
    leftmost merges first; rows that repeat are each answered; an empty table gives no rows; other
    columns are not read.
    """
    narrow_batches(spark)
    return bpe.round_trip(read(spark, sf_dir, "documents"), TOKENIZER)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back: one row for each row of pages.

    Null and empty pages have payloads of no bytes; pages of any length are one record; of equal
    payloads the largest id is the response; rows that repeat are each written; an empty table gives
    no rows; other columns are not read.
    """
    narrow_batches(spark)
    stored = write_table(warc.write_archives(read(spark, sf_dir, "pages")), "warc")
    return warc.read_archives(stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies: one row for each row of documents.

    Null, empty and blank texts have no shingles and are alone; texts of any length count whole; ties
    do not arise, since a group is named by its smallest id; rows that repeat an id are each answered
    by their text; an empty table gives no rows; other columns are not read.
    """
    narrow_batches(spark)
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row of embeddings whose id 20 divides.

    Null, zero and non-finite vectors and rows without an id take no part; vectors of several lengths
    are searched length by length; equal scores go to the smaller id; rows that repeat an id are
    candidates of each other, and each is answered; an empty table gives no rows; other columns are
    not read.
    """
    narrow_batches(spark)
    return ann.search(read(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text: one row for each row of documents.

    Null, empty and blank texts get the training share of ones; texts of any length count whole; equal
    texts have equal scores; rows that repeat are each scored, and an id counts once in training; an
    empty table gives no rows, and without labels the score is the same for all; other columns are not
    read.
    """
    narrow_batches(spark)
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = _crc(F.col("doc_id")) % 3 == 1
    found = quality.score(docs, quality.train(docs, learnable(labels)))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in windows of 2048 tokens: one row for each piece of documents.

    Null and empty texts are one piece, the end token; texts of any length are cut into full windows
    and a rest; of equally tight windows any may be taken; rows that repeat are each packed; an empty
    table gives no rows; other columns are not read.
    """
    narrow_batches(spark)
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of near copies: one row for each row of documents.

    Null, empty and blank texts have fingerprint zero and link like others; texts of any length count
    whole; ties do not arise, since a group is named by its smallest id; rows that repeat an id are
    each answered by their text; an empty table gives no rows; other columns are not read.
    """
    narrow_batches(spark)
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language: none for a language without a frequent one.

    Null and empty texts have no words, a null language is `und`; texts of any length count whole; of
    equal scores the more frequent phrase comes first, then the smaller by its bytes; rows that repeat
    count each; an empty table gives no rows; other columns are not read.
    """
    narrow_batches(spark)
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of embeddings: one row for each row with 64 finite components.

    Null vectors, those of other lengths and those with null or non-finite components give no row;
    rows without an id are answered but come last as first centroids; equal distances go to the
    smaller number; rows that repeat are each answered; an empty table gives no rows; other columns
    are not read.
    """
    narrow_batches(spark)
    return clusters.cluster(read(spark, sf_dir, "embeddings"))


_ALL = (
    op1_media_columns, op2_language_id, op3_toxicity, op4_line_dedup, op5_bpe, op6_warc, op7_ngram_jaccard, op8_ann, op9_quality, op10_packing, op11_simhash, op12_phrases, op13_clusters,
)
QUERIES = {f.__name__: f for f in _ALL}
