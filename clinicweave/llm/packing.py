"""Packing of token sequences into fixed windows, best fit decreasing.

Documents are tokenised where they lie; only (document, start, length, checksum) moves on. Overlong
documents are first cut into full windows. Pieces are dealt into shards of bounded size, and each
shard is packed on its own: longest first, each piece into the tightest open window that holds it,
found by a segment tree over remaining capacities.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoded, loaded
from .common import write_table

WINDOW, END_ID, SHARD = 2048, 1, 20_000
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Capacities:
    """Counts of open windows by remaining capacity; `fit` finds the least capacity >= want."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def fit(self, want: int) -> int | None:
        at = self.leaves + want
        if self.count[at]:
            return want
        while at > 1:  # up until a right sibling holds a window, then down to its leftmost
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) of each piece; pieces are placed longest first."""
    open_by: dict[int, list[int]] = {}
    tree, used, out = Capacities(window), 0, [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        size = lengths[k]
        room = tree.fit(size)
        if room is None:
            at, room, used = used, window, used + 1
        else:
            at = open_by[room].pop()
            tree.add(room, -1)
        out[k] = (at, window - room)
        if room > size:
            open_by.setdefault(room - size, []).append(at)
            tree.add(room - size, 1)
    return out


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids followed by `end_id`: full windows first, then the rest."""

    def run(batches):
        end = end_id.to_bytes(4, "little")
        for names, texts in encoded(batches, loaded(path)):
            rows = []
            for name, ids in zip(names.to_pylist(), texts):
                ids += end
                total = len(ids) // 4
                for at in range(0, total, window):
                    part = ids[4 * at : 4 * (at + window)]
                    rows.append((name, at, len(part) // 4, zlib.crc32(part), total))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _PIECE)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece, the end id. Repeated rows are packed each; ids may be null;
    no documents give no rows. Sequence numbers are unique over all shards.
    """
    cut = write_table(pieces(docs, path, window, end_id, id_col, text_col), "pieces")
    shards = max(1, -(-cut.count() // shard))

    def place(group: pa.Table) -> pa.Table:
        if not group.num_rows:
            return group.rename_columns([*group.column_names[:5], "sequence_id"]).append_column("offset", pa.array([], pa.int64()))
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        spots = best_fit(group.column("length").to_pylist(), window)
        base = group.column("shard")[0].as_py() << 32
        return group.drop_columns(["shard"]).append_column("sequence_id", pa.array([base + s for s, _ in spots], pa.int64())).append_column("offset", pa.array([o for _, o in spots], pa.int64()))

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(place, _PIECE + ", sequence_id long, offset long")
