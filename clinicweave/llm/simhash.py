"""SimHash near-duplicates: fingerprints of word shingles, compared exactly, tile by tile.

Equal fingerprints collapse first, so copies cost one comparison in all. A fingerprint's tile is given
by the population counts of its segments (1, 2, 4, 8 or 16 of equal width, more of them for more
fingerprints, so that tiles stay small). The population counts of two fingerprints differ by no more
than their bits do, summed over the segments; so only tiles whose counts differ by `radius` at most
in this sum are compared, and all other pairs of tiles are skipped. A pair of tiles is an exclusive or
and a bit count over two arrays. Tiles that hold many fingerprints are dealt into parts, so that every
task compares arrays of bounded size, and a task sends on what links its components only, not every
pair of a dense group. Nothing is lost: every pair of fingerprints within the radius is compared.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_table, give_back, reread, small, write_table

WORDS, SEED = 3, 42
TILE = 2048  # fingerprints that a tile should hold, as seen by one of them
PART = 4096  # fingerprints of an array
# chance that two random segments of so many bits have equal population counts
_ALIKE = {64: 0.0704, 32: 0.0993, 16: 0.1399, 8: 0.1964, 4: 0.2734}


def fingerprint(text: str | None, words: int = WORDS, at_once: int = 65_536) -> int:
    """Bits that are set in over half of the shingles' hashes; 0 for texts without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.array([len(w) for w in found]) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    starts, ends = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), at_once):
        h = np.array([digest(line[i:j], SEED) for i, j in zip(starts[at : at + at_once], ends[at : at + at_once])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def _prints(words: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                part = whole.slice(at, 200)
                found = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return lambda batches: give_back(run(batches))


def segments(prints: int, tile: int = TILE) -> int:
    """Into how many segments fingerprints are cut, so that one meets about `tile` others in its own tile."""
    return next((n for n in (1, 2, 4, 8) if prints * _ALIKE[64 // n] ** n <= tile), 16)


def tile(n: int) -> F.Column:
    """The tile of a fingerprint: the population count of each of its `n` segments, two up, side by side."""
    wide = 64 // n
    mask = -1 if n == 1 else (1 << wide) - 1
    each = [(F.bit_count(F.shiftrightunsigned("fp", wide * i).bitwiseAND(F.lit(mask))) + 2).cast("long") for i in range(n)]
    out = each[0]
    for i in range(1, n):
        out = out.bitwiseOR(F.shiftleft(each[i], wide * i))
    return out


def steps(n: int, radius: int) -> np.ndarray:
    """What leads from a tile to those within `radius`, each pair of tiles once, and to itself."""
    wide, found = 64 // n, {(0,) * n}
    for _ in range(radius):
        found |= {tuple(x + d * (i == j) for j, x in enumerate(s)) for s in found for i in range(n) for d in (-1, 1)}
    half = [s for s in found if next((x for x in s if x), 1) > 0]
    return np.array([sum(x << (wide * i) for i, x in enumerate(s)) % 2**64 for s in sorted(half)], np.uint64)


def _near(n: int, radius: int):
    """Pairs (a, b) of tiles that may hold fingerprints within the radius."""
    to = steps(n, radius)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                a = batch.column(0).slice(at, 1000).to_numpy()
                b = (a.view(np.uint64)[:, None] + to[None]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a, len(to))), pa.array(b.ravel())], names=["a", "b"])

    return run


class _Forest:
    """Components of places."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return False
        one, two = self.members.pop(a, [a]), self.members.pop(b, [b])
        if len(one) > len(two):
            a, b, one, two = b, a, two, one
        self.label[one] = b
        self.members[b] = two + one
        return True


def close(x: np.ndarray, y: np.ndarray | None, radius: int, cells: int = 1_000_000) -> list[tuple[int, int]]:
    """Pairs of fingerprints within `radius`, of `x` and `y` or within `x`, as few as join what all such pairs join."""
    both = x if y is None else np.concatenate([x, y])
    other, shift = (x, 0) if y is None else (y, len(x))
    forest, out = _Forest(len(both)), []
    step = max(1, cells // max(1, len(other)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, :]) <= radius)
        i, j = i + at, j + shift
        while True:  # pairs of places that are not joined yet: one of each pair of components at a time
            a, b = forest.label[i], forest.label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            _, first = np.unique(np.minimum(a, b) * np.int64(len(both)) + np.maximum(a, b), return_index=True)
            for p, q in zip(i[first].tolist(), j[first].tolist()):
                if forest.join(p, q):
                    out.append((p, q))
    return [(int(both[p]), int(both[q])) for p, q in out]


def _compare(radius: int):
    """Edges between the fingerprints of two arrays, or within one where the second is null."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for one, two in zip(batch.column(0), batch.column(1)):
                x = one.values.to_numpy().view(np.uint64)
                for p, q in close(x, two.values.to_numpy().view(np.uint64) if two.is_valid else None, radius):
                    a.append(p)
                    b.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return lambda batches: give_back(run(batches))


def links(prints: DataFrame, count: int, radius: int, part: int = PART, n: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that join what the radius joins."""
    n = n or segments(count)
    found = prints.withColumn("tile", tile(n))
    sizes = write_table(found.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(part)).cast("int").alias("parts")), "sizes")
    tiles = sizes.count()
    dealt = found.join(small(sizes, tiles, 12), "tile").groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list("fp").alias("fps"))
    dealt = write_table(dealt, "tiles")  # about `part` fingerprints a row
    ends = lambda name, out: small(reread(sizes).select(F.col("tile").alias(name), F.col("parts").alias(out)), tiles, 12)
    pairs = sizes.select("tile").mapInArrow(_near(n, radius), "a long, b long").join(ends("a", "pa"), "a").join(ends("b", "pb"), "b")
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pa") - 1))).withColumn("j", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0), F.col("pb") - 1)))
    side = lambda t, p, out: reread(dealt).select(F.col("tile").alias(t), F.col("part").alias(p), F.col("fps").alias(out))
    again = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    met = pairs.select("a", "i", "b", "j").join(side("a", "i", "x"), ["a", "i"])
    met = met.where(~again).join(side("b", "j", "y"), ["b", "j"]).select("x", "y").union(met.where(again).select("x", F.lit(None).cast("array<long>")))
    out = write_table(met.mapInArrow(_compare(radius), "a long, b long"), "near")
    drop_table(sizes)
    drop_table(dealt)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row.

    Fingerprints link at `radius` differing bits or fewer; the component is the smallest id that links
    reach. Null, empty and blank texts have fingerprint 0 and link like others; texts of any length
    count whole. Rows that repeat an id are each answered by their text; rows without an id link like
    others, and have no component where no linked row has an id. Ties do not arise. Empty tables give
    empty results; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = write_table(slim.mapInArrow(_prints(words), "doc_id long, fp long"), "prints")
    least = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    count = least.count()
    near = links(least.select("fp"), count, radius)
    found = components(near).select(F.col("v").alias("fp"), "c")
    homes = least.join(found, "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    names = homes.groupBy("c").agg(F.min("least").alias("component_id"))
    homes = write_table(homes.join(names, "c").select("fp", "component_id"), "homes")
    for table in (least, near):
        drop_table(table)
    # a fingerprint that many rows share is one row on the other side; its rows are split where they are many
    out = prints.join(small(homes, count, 24), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out
