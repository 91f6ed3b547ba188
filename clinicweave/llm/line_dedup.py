"""Line deduplication over a whole corpus by deletion neighbourhoods.

A line (trimmed, not blank) goes when an equal line first occurs earlier in (document id, hash of the
text, line number) order, or, from `near_chars` characters on, a line within one character edit does:
the edit bound is one, and none for shorter lines, where one edit makes another word. Blank lines
part paragraphs and stay.

All lines are cut and hashed once, into a table that the later steps read by column. Exact repeats
are settled by hashes alone. For near repeats, an edit leaves either the first or the last `p`
characters of both lines untouched, where `p` is about half their length; two such hashes a line
(four where `p` changes with one character) find every line that can have a partner at all, and hashes
of exact halves with lengths thin these out. What is left emits its deletion neighbourhood as hashed keys: each line with one character
deleted, tagged with the place (equal keys differ by a substitution), and the same without the place
beside the line itself (equal keys differ by an insertion). Members of a key are joined to the
earliest one only, so that a key shared by a third of all lines stays linear, and edit distance is
verified on the lines themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, free, map_columns, reread, small, write_table

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_TRIM = " \t\r"
_STEP = 4  # lengths of compared ends are multiples of this
_POS = ("doc", "th", "at")  # a line's place: id and hash of the text that tell the row, and the line's number


def _ends() -> F.Column:
    """Hashes of the line's first and last characters, for partners as long, longer by one, or shorter by one."""
    line, n = F.col("line"), F.col("n")
    size = lambda m: (F.floor(m / (2 * _STEP)) * _STEP).cast("int")
    pair = lambda p: [F.xxhash64(F.lit(0), p, F.substring(line, F.lit(1), p)), F.xxhash64(F.lit(1), p, F.substring(line, n - p + 1, p))]
    return F.when(size(n) == size(n - 1), F.array(*pair(size(n)))).otherwise(F.array(*pair(size(n)), *pair(size(n - 1))))


def _halves() -> F.Column:
    """Hashes of the line's first and second half, with the length of the shorter line: for partners as long, longer by one, or shorter by one."""
    line, n = F.col("line"), F.length("line")
    keys = []
    for m in (n, n - 1):
        p = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.lit(0), m, F.substring(line, F.lit(1), p)), F.xxhash64(F.lit(1), m, F.substring(line, n - (m - p) + 1, m - p))]
    return F.array(*keys)


def cut(docs: DataFrame, id_col: str, text_col: str, near_chars: int) -> DataFrame:
    """One row per line that is not blank: doc, th, at, h1, h2, ends (none below `near_chars`), line."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(_TRIM))).withColumn("n", F.length("line")).where("n > 0")
    return rows.select(*_POS, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.when(F.col("n") >= near_chars, _ends()).otherwise(F.array().cast("array<long>")).alias("ends"), "line")


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(31))


def deletion_keys(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the line's deletion neighbourhood and their kinds: 0 placed, 1 unplaced, 2 the line itself."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _BASE)]).astype(np.uint64), dtype=np.uint64)
    upto = np.concatenate([[np.uint64(0)], np.cumsum(_mix(c + np.uint64(1), 1) * power[:n], dtype=np.uint64)])
    cut_out = upto[:-1] + (upto[-1] - upto[1:]) * _BACK
    place = np.arange(n, dtype=np.uint64)
    placed = _mix(_mix(cut_out, 2) + place * _BASE, 3 + 2 * n)
    loose = np.unique(_mix(cut_out, 4 + 2 * (n - 1)))
    own = _mix(upto[-1:], 4 + 2 * n)
    keys = np.concatenate([placed, loose, own]).view(np.int64)
    return keys, np.repeat(np.array([0, 1, 2], np.int8), [len(placed), len(loose), 1])


def _emit(batches, chars: int = 50_000):
    """(key, kind, h1) of each line's neighbourhood, for about `chars` characters at a time."""
    def flush(ids, found):
        keys, kinds = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(kinds)), pa.array(np.repeat(ids, [len(k) for k in keys]))], names=["key", "kind", "h1"])

    for batch in batches:
        ids, found, size = [], [], 0
        for h1, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(h1)
            found.append(deletion_keys(line))
            size += len(line)
            if size >= chars:
                yield flush(np.array(ids, np.int64), found)
                ids, found, size = [], [], 0
        if ids:
            yield flush(np.array(ids, np.int64), found)


def within_one(a: str, b: str) -> bool:
    """True if one substitution, insertion or deletion at most turns `a` into `b`."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    lo, hi = 0, len(a)
    while lo < hi:  # common prefix by bisection on slices
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return a[lo + 1 :] == b[lo + 1 :] if len(a) == len(b) else a[lo:] == b[lo + 1 :]


def _check(batches):
    for batch in batches:
        ok = [within_one(a, b) for a, b in zip(batch.column("la").to_pylist(), batch.column("lb").to_pylist())]
        yield batch.select(["h1", "h2"]).filter(pa.array(ok, pa.bool_()))


def near(lines: DataFrame) -> DataFrame:
    """Hashes (h1, h2) of distinct lines that have an earlier line within one edit."""
    ends = lines.select(*_POS, "h1", "h2", F.explode("ends").alias("key"))
    common = write_table(ends.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key"), "ends")
    chosen = ends.join(small(common, common.count(), 16), "key", "left_semi").groupBy("h1", "h2").agg(F.min(F.struct(*_POS)).alias("first"))
    chosen = write_table(chosen.select("h1", "h2", "first.*"), "chosen")
    drop_table(common)
    pick = small(chosen, chosen.count(), 48)
    kept = lines.select(*_POS, "h1", "h2", "line").alias("l").join(pick.alias("p"), F.expr("l.h1 = p.h1 and l.h2 = p.h2 and l.doc <=> p.doc and l.th = p.th and l.at = p.at"), "left_semi")
    rough = write_table(kept.dropDuplicates(["h1"]), "rough")
    drop_table(chosen)
    # these few are compared again, by halves and lengths
    halves = rough.select("h1", F.explode(_halves()).alias("key"))
    alike = halves.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    kept = write_table(reread(rough).join(halves.join(alike, "key", "left_semi").select("h1").distinct(), "h1", "left_semi"), "lines")
    drop_table(rough)
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes of lines make many keys, so their tasks are not put together
    keys = kept.repartition(parts, "h1").select("h1", "line").mapInArrow(_emit, "key long, kind byte, h1 long")
    met = write_table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("kind").alias("lo"), F.max("kind").alias("hi")).where("k > 1 and not (lo = 1 and hi = 1)").select("key"), "met")
    some = keys.join(small(met, met.count(), 16), "key", "left_semi").join(kept.select("h1", *_POS), "h1")
    some = write_table(some.select("key", "kind", "h1", F.struct(*_POS).alias("pos")), "some")
    drop_table(met)
    # placed keys: all members are one substitution apart; unplaced ones: only beside the line itself
    lead = some.where("kind in (0, 2)").groupBy("key").agg(F.min_by("h1", "pos").alias("other"), F.min("pos").alias("best"))
    a = some.where("kind in (0, 1)").join(lead, "key").where(F.col("best") < F.col("pos")).select("h1", "other")
    loose = some.where("kind = 1").groupBy("key").agg(F.min_by("h1", "pos").alias("other"), F.min("pos").alias("best"))
    b = some.where("kind = 2").join(loose, "key").where(F.col("best") < F.col("pos")).select("h1", "other")
    pairs = a.union(b).distinct()
    pairs = pairs.join(kept.select("h1", "h2", F.col("line").alias("la")), "h1").join(kept.select(F.col("h1").alias("other"), F.col("line").alias("lb")), "other")
    out = write_table(pairs.select("h1", "h2", "la", "lb").mapInArrow(_check, "h1 long, h2 long").distinct(), "near")
    drop_table(some)
    drop_table(kept)
    return out


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = 16) -> DataFrame:
    """Rows (doc, th, at): the lines that go, by document id, hash of the text and line number from 0."""
    lines = write_table(cut(docs, id_col, text_col, near_chars), "cut")
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h1", "h2")
    again = write_table(lines.select(*_POS, "h1", "h2").join(often, ["h1", "h2"], "left_semi"), "again")
    first = again.groupBy("h1", "h2").agg(F.min(F.struct(*_POS)).alias("first"))
    exact = again.join(first, ["h1", "h2"]).where(F.struct(*_POS) != F.col("first")).select(*_POS)
    found = near(lines)
    also = lines.select(*_POS, "h1", "h2").join(small(found, found.count(), 24), ["h1", "h2"], "left_semi").select(*_POS)
    out = write_table(exact.union(also).distinct(), "removed")
    for table in (lines, again, found):
        drop_table(table)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = 16, counts: bool = False) -> DataFrame:
    """`docs` with repeated lines taken out of `text_col`; rows, order of lines and other columns stay.

    Null texts stay null and empty ones empty; a document whose lines all occurred before is left
    with its blank lines or an empty text. Lines count in order of (document id, hash of the text,
    line number), ids that are null first. Rows that repeat an id are told apart by their texts; rows
    that repeat both hold the same lines at the same places and keep the same ones. Texts and lines
    may be of any length. Empty tables give empty results; columns may have any names. With `counts`,
    adds n_lines and n_removed (0 for null texts), in place of columns of these names.
    """
    if counts:
        docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    doc, th, gone_doc, gone_th, gone = free(docs, "doc", "th", "gone_doc", "gone_th", "gone")
    cut_out = removed_lines(docs, id_col, text_col, near_chars).groupBy(F.col("doc").alias(gone_doc), F.col("th").alias(gone_th)).agg(F.collect_list("at").alias(gone))
    keyed = docs.withColumns({doc: F.col(id_col).cast("long"), th: F.xxhash64(F.col(text_col).cast("string"))})
    # by shuffle at every size: what goes grows with the documents
    joined = keyed.join(cut_out, F.col(doc).eqNullSafe(F.col(gone_doc)) & (F.col(th) == F.col(gone_th)), "left").drop(doc, th, gone_doc, gone_th)
    at = names.index(text_col)

    def rebuild(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                out, total, lost = [], [], []
                for text, drop in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                    lines = [] if text is None else text.split("\n")
                    drop = set(drop or ())
                    out.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
                    total.append(len(lines))
                    lost.append(len(drop))
                columns = [batch.column(i) if i != at else pa.array(out, batch.schema.field(at).type) for i in range(len(names))]
                if counts:
                    columns += [pa.array(total, pa.int64()), pa.array(lost, pa.int64())]
                yield columns

    more = (("n_lines", T.LongType()), ("n_removed", T.LongType())) if counts else ()
    return map_columns(joined, rebuild, *more, left_out=1)
