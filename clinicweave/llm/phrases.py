"""Phrase collocations by language: merged count-min sketches, an exact second pass over what survives, scores.

A first pass adds every n-gram of one to four words to a count-min sketch of two rows. Counters are
bytes that stop at 255, which is far above any threshold that is asked of them, so merging them never
makes a count too small. Tasks send their sketch in chunks, compressed, and chunks are merged by
place; what is left of a counter is one bit, whether it reaches the threshold. The bits are bounded
by the width and are broadcast. A second pass looks up each n-gram: one whose counters both reach
the threshold, and whose shorter parts survive too, is counted exactly by its words. A sketch only
overestimates and a phrase is never more frequent than its parts, so nothing frequent is lost. The
sketch grows with the text up to `WIDEST`; beyond, more n-grams survive and are counted exactly, by
the same way.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, give_back, small, write_table

LONGEST = 4
CHUNK = 1 << 16  # counters that are merged together
WIDEST = 1 << 27  # counters of a row at most: two rows of bits are 32 MB
TASK = 1 << 29  # characters that a task reads at most; a core's share if that is less
UNKNOWN = "und"
_SEPARATORS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", b"\n" * 10)
_TOKEN = re.compile(rb"[^ \t\n]+|\n")
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class _Words(dict):
    """Hash of each word, remembered up to a bound; 0 stands for the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = 0 if word == b"\n" else xxhash.xxh64_intdigest(word) or 1
        return h


def tokens(text: str) -> list[bytes]:
    """Words of a text and a new line wherever a piece ends, A to Z in lower case."""
    return _TOKEN.findall(text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _K[0]
    return h ^ (h >> np.uint64(29))


def grams(words: np.ndarray, seeds: np.ndarray):
    """For sizes 1 to `LONGEST`: hashes of the n-grams that start at each word, and which of these lie within a piece."""
    inside = words != 0
    h = _mixed(words ^ seeds)
    yield h, inside
    for n in range(1, LONGEST):
        if len(words) <= n:
            return
        h = _mixed(h[:-1] ^ (words[n:] * _K[1]))
        inside = inside[:-1] & (words[n:] != 0)
        yield h, inside


def _runs(batches, limit: int = 400_000):
    """(words, hashes, seed of each word's language, languages, which of them) of texts, about `limit` words at a time."""
    cache = _Words()
    found, of, names = [], [], {}
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not text:
                    continue
                more = tokens(text)
                k = names.setdefault(lang, len(names))
                found += more
                found.append(b"\n")
                of.append((k, len(more) + 1))
                if len(found) >= limit:
                    yield _run(found, of, names, cache)
                    found, of = [], []
    if found:
        yield _run(found, of, names, cache)


def _run(found: list, of: list, names: dict, cache: _Words):
    hashes = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    which = np.repeat(np.array([k for k, _ in of], np.int32), [n for _, n in of])
    seeds = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 1) for x in names], np.uint64)
    return found, hashes, seeds[which], list(names), which


def places(h: np.ndarray, width: int) -> list[np.ndarray]:
    """Counters of each hash in the two rows of a sketch."""
    shift = np.uint64(64 - width.bit_length() + 1)
    return [(h >> shift).astype(np.int64), ((h * _K[1]) >> shift).astype(np.int64)]


def _sketch(width: int):
    """Chunks (part, counters) of the sketch of a task; parts of the second row follow those of the first."""

    def run(batches):
        counters = [np.zeros(width, np.uint8) for _ in range(2)]
        some = False
        for _, words, seeds, _, _ in _runs(batches):
            some = True
            held, times = np.unique(np.concatenate([h[inside] for h, inside in grams(words, seeds)]), return_counts=True)
            for row, at in zip(counters, places(held, width)):
                order = np.argsort(at, kind="stable")  # the first row's are in order already
                at, n = at[order], times[order]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
                row[at[first]] = np.minimum(row[at[first]] + (np.add.reduceat(n, first) if len(at) else 0), 255).astype(np.uint8)
        press = zstandard.ZstdCompressor(level=1)
        for k, row in enumerate(counters if some else ()):
            step = min(CHUNK, width)
            for first in range(0, width, step * 64):
                parts = [i for i in range(first, min(width, first + step * 64), step) if row[i : i + step].any()]
                data = [press.compress(row[i : i + step].tobytes()) for i in parts]
                yield pa.RecordBatch.from_arrays([pa.array([k * (width // step) + i // step for i in parts], pa.int32()), pa.array(data, pa.binary())], names=["part", "counters"])

    return lambda batches: give_back(run(batches))


def _merge(least: int, step: int):
    """One bit for each counter of a chunk: whether the merged count reaches `least`."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(step, np.uint16)
        for data in table.column("counters"):
            total = np.minimum(total + np.frombuffer(zstandard.decompress(data.as_py()), np.uint8), 255).astype(np.uint16)
        return pa.table({"part": pa.array(table.column("part").to_pylist()[:1], pa.int32()), "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    return run


def sketch(rows: DataFrame, least: int, width: int) -> np.ndarray:
    """Bits of the merged sketch, two rows of `width`: which counters reach `least`. `least` is 255 at most."""
    step = min(CHUNK, width)
    parts = rows.mapInArrow(_sketch(width), "part int, counters binary").groupBy("part").applyInArrow(_merge(least, step), "part int, bits binary")
    bits = np.zeros(2 * width // 8, np.uint8)
    for row in parts.toArrow().to_pylist():  # `WIDEST` bounds it
        at = row["part"] * step // 8
        bits[at : at + step // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _reach(bits: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Whether both counters of each hash reach the threshold."""
    out = np.ones(len(h), bool)
    for k, at in enumerate(places(h, width)):
        at = at + k * width
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


class _Tally:
    """Phrases that a task holds, by their hash: in order, with counts, languages and words."""

    def __init__(self):
        self.keys, self.n, self.at = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.langs: list[int] = []
        self.phrases: list[bytes] = []

    def add(self, keys: np.ndarray, n: np.ndarray, lang, phrase) -> None:
        """Sorted distinct keys and their counts; `lang(i)` and `phrase(i)` tell of the i-th where it is new."""
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        self.n[place[known]] += n[known]
        new = np.flatnonzero(~known)
        at = len(self.phrases) + np.arange(len(new))
        for i in new.tolist():
            self.langs.append(lang(i))
            self.phrases.append(phrase(i))
        self.keys, self.n, self.at = (np.insert(x, place[new], y) for x, y in ((self.keys, keys[new]), (self.n, n[new]), (self.at, at)))

    def batches(self, names: list[str]):
        n = np.empty(len(self.n), np.int64)
        n[self.at] = self.n
        for i in range(0, len(n), 50_000):
            phrase, lang = self.phrases[i : i + 50_000], [names[k] for k in self.langs[i : i + 50_000]]
            size = [x.count(b" ") + 1 for x in phrase]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int8()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n[i : i + 50_000])], names=["lang", "size", "phrase", "n"])


def _survivors(shared, width: int, hold: int = 2_000_000):
    """(lang, size, phrase, n): exact counts, within a task, of the n-grams that survive; size 0 holds the words of a language."""

    def run(batches):
        bits, held, total, names = shared.value, _Tally(), np.zeros(0, np.int64), []
        for found, words, seeds, names, which in _runs(batches):
            n = np.bincount(which[words != 0], minlength=len(names))
            n[: len(total)] += total
            total, alive, some = n, None, []
            for size, (h, inside) in enumerate(grams(words, seeds), 1):
                if alive is not None:
                    inside = inside & alive[:-1] & alive[1:]  # both shorter parts survive
                at = np.flatnonzero(inside)
                at = at[_reach(bits, h[at], width)]
                alive = np.zeros(len(h), bool)
                alive[at] = True
                some.append((h[at], at, np.full(len(at), size)))
            h, at, size = (np.concatenate(x) for x in zip(*some))
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            at, size = at[first], size[first]
            held.add(u, n, lambda i: int(which[at[i]]), lambda i: b" ".join(found[at[i] : at[i] + size[i]]))
            if len(held.keys) > hold:
                yield from held.batches(names)
                held = _Tally()
        yield from held.batches(names)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int8()), pa.array([""] * len(names), pa.string()), pa.array(total)], names=["lang", "size", "phrase", "n"])

    return lambda batches: give_back(run(batches))


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30) -> DataFrame:
    """(lang, size, phrase, f): every n-gram of one to four words that occurs `least` times or more, and size 0: all words of the language.

    A table in the shared folder. Null texts and empty ones have no words; a null language is `und`.
    `least` is 255 at most.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")
    chars = rows.agg(F.sum(F.length("text").cast("decimal(38,0)"))).first()[0] or 0
    width = min(WIDEST, max(1 << 10, 1 << (int(chars) // 16).bit_length()))
    context = docs.sparkSession.sparkContext
    # a task sends a sketch and its own share of the survivors, whatever it reads: so few tasks, each with much text
    rows = rows.coalesce(max(context.defaultParallelism, -(-int(chars) // TASK)))
    shared = context.broadcast(sketch(rows, least, width))
    found = rows.mapInArrow(_survivors(shared, width), "lang string, size byte, phrase string, n long")
    return write_table(found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).where((F.col("size") == 0) | (F.col("f") >= least)), "phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, scale: int = 2_000_000, cover: int = 80, spread: int = 32) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two to four words.

    a: occurrences of a phrase of `least` or more; l and r: those of the parts before and behind the
    cut with the lowest score floor(scale * a / (l + r)), the first of equal cuts; n: all words of the
    language. A phrase goes if a longer one that holds it has `cover` hundredths of its occurrences or
    more, whether that goes too or not. By score, then a, both descending, then by the phrase's bytes.
    Products are decimals, so they are exact beyond 64 bits. Null and empty texts have no words; a
    null language counts as `und`; texts of any length count whole and rows that repeat count each;
    an empty table gives no rows; other columns are ignored.
    """
    counted = frequent(docs, text_col, lang_col, least)
    rows = counted.where("size > 0").count()
    held = lambda df: small(df, rows, 96)
    part = lambda name, out: held(counted.where(f"size between 1 and {LONGEST - 1}").select("lang", F.col("phrase").alias(name), F.col("f").alias(out)))
    wide = lambda x: F.col(x).cast("decimal(20,0)")
    longer = counted.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    words = lambda start, n: F.array_join(F.slice("w", start, n), " ")

    cut = longer.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", words(F.lit(1), F.col("k")).alias("first"), words(F.col("k") + 1, F.col("size").cast("int")).alias("rest"))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))) div cast(cast(l as decimal(20,0)) + cast(r as decimal(20,0)) as decimal(38,0))")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.score", "best.l", "best.r")

    inner = [(start, n) for n in range(2, LONGEST) for start in range(1, LONGEST - n + 2)]
    parts = F.array(*(F.when(F.col("size") >= max(n + 1, start + n - 1), words(F.lit(start), F.lit(n))) for start, n in inner))
    over = longer.where("size > 2").select("lang", "a", F.explode(F.array_compact(parts)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    left = scored.join(held(over), ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * wide("over") < cover * wide("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(spread))).orderBy(*order)  # a language is first ranked in parts
    left = left.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = F.broadcast(counted.where("size = 0").select("lang", F.col("f").alias("n")))  # a row for each language
    out = left.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = write_table(out, "collocations")
    drop_table(counted)
    return out
