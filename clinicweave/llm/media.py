"""Media columns: payloads in ISO base media files, and features read from their boxes alone.

`to_media` stores bytes as the samples of one track; `probe` walks the nested boxes of any such
file, decodes each track's sample tables and gives codec, duration and the byte ranges of keyframes
without touching the samples; `payload` reads the samples' bytes back through the tables. Samples of
fragments (moof boxes) follow those of the moov box; sizes may stand in stsz or stz2 tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

RATE = 8000  # samples a second, one byte each
UNIT, PER_CHUNK, KEY_EVERY, PAD = 4096, 8, 4, 64
_HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack(">I4s", len(data) + 8, kind) + data


def _full(kind: bytes, *body: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *body)


def _table(kind: bytes, rows: np.ndarray) -> bytes:
    return _full(kind, struct.pack(">I", len(rows)), rows.astype(">u4").tobytes())


def padded(payload: bytes) -> bytes:
    """Zeros up to a positive multiple of 64 bytes."""
    return payload + bytes(-len(payload) % PAD if payload else PAD)


def to_iso(payload: bytes) -> bytes:
    """One file: the payload as 8-bit samples in units of 4096 bytes, every fourth a keyframe."""
    n = len(payload)
    units = -(-n // UNIT)
    sizes = np.full(units, UNIT)
    sizes[-1] = n - UNIT * (units - 1)
    runs = np.array([[units - 1, UNIT], [1, sizes[-1]]] if units > 1 else [[1, n]])
    chunks = -(-units // PER_CHUNK)
    rest = units - PER_CHUNK * (chunks - 1)
    per = np.array([[1, PER_CHUNK, 1], [chunks, rest, 1]] if chunks > 1 else [[1, rest, 1]])
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        at = first + np.arange(chunks, dtype=np.int64) * UNIT * PER_CHUNK
        offsets = _table(b"stco", at) if at[-1] < 2**32 else _full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes())
        stbl = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _table(b"stts", runs), _table(b"stsc", per),
            _full(b"stsz", struct.pack(">II", 0, units), sizes.astype(">u4").tobytes()), offsets, _table(b"stss", np.arange(1, units + 1, KEY_EVERY)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1")))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"), minf)
        tkhd = _box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8))
        mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 8 if n + 8 < 2**32 else 16
    first = len(ftyp) + len(moov(0)) + head
    mdat = struct.pack(">I4s", n + 8, b"mdat") if head == 8 else struct.pack(">I4sQ", 1, b"mdat", n + 16)
    return b"".join([ftyp, moov(first), mdat, payload])


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: str = ""):
    """(path, body start, body end) of each box, those inside containers included."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, start + head, start + size
        if kind in _HOLDERS:
            yield from boxes(data, start + head, start + size, name)
        start += size


def _rows(data: memoryview, at: int, width: int, kind: str = ">u4") -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + 4)
    return np.frombuffer(data, kind, n * width, at + 8).astype(np.int64).reshape(n, width)


def tables(data: memoryview) -> list[dict]:
    """Of each track: kind (its handler), codec, time scale, duration, and offset, size and keyframe flag of its samples.

    Tables that do not fit together, or point outside of the file, are an error.
    """
    tracks: list[dict[str, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, int, int]] = {}  # by track: duration, size and flags of a sample
    runs: list[tuple[int, int, int, list[int]]] = []  # by fragment: moof, tfhd, track and its truns
    moof = 0
    for path, start, end in boxes(data):
        if path == "/moov/trak":
            tracks.append({})
        elif path.startswith("/moov/trak/"):
            tracks[-1].setdefault(path.rsplit("/", 1)[1], (start, end))
        elif path == "/moov/mvex/trex":
            track, _, *rest = struct.unpack_from(">5I", data, start + 4)
            defaults[track] = tuple(rest)
        elif path == "/moof":
            moof = start - (8 if data[start - 4 : start] == b"moof" else 16)  # where the box begins, by the size of its header
        elif path == "/moof/traf/tfhd":
            runs.append((moof, start, struct.unpack_from(">I", data, start + 4)[0], []))
        elif path == "/moof/traf/trun":
            runs[-1][3].append(start)
    found = [_table_of(data, t) for t in tracks]
    if runs:
        ids = [struct.unpack_from(">I", data, t["tkhd"][0] + (20 if data[t["tkhd"][0]] == 1 else 12))[0] for t in tracks]
        for of, track in zip(ids, found):
            _append(data, track, [(m, h, truns) for m, h, t, truns in runs if t == of], defaults.get(of, (0, 0, 0)))
    return found


_NOT_SYNC = 0x10000


def _append(data: memoryview, track: dict, fragments: list[tuple[int, int, list[int]]], defaults: tuple[int, int, int]) -> None:
    """Adds the samples of a track's fragments, in the order of the file."""
    parts, ticks = [], 0
    for moof, head, truns in fragments:
        (flags,) = struct.unpack_from(">I", data, head)
        at, values = head + 8, list(defaults)
        base = moof
        if flags & 0x1:
            (base,) = struct.unpack_from(">Q", data, at)
            at += 8
        at += 4 * bool(flags & 0x2)
        for k, bit in enumerate((0x8, 0x10, 0x20)):
            if flags & bit:
                (values[k],) = struct.unpack_from(">I", data, at)
                at += 4
        place = base
        for start in truns:
            flags, n = struct.unpack_from(">II", data, start)
            at, first = start + 8, None
            if flags & 0x1:
                place = base + struct.unpack_from(">i", data, at)[0]
                at += 4
            if flags & 0x4:
                (first,) = struct.unpack_from(">I", data, at)
                at += 4
            own = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            if n * max(1, 4 * len(own)) > len(data):
                raise ValueError("more samples than the file can hold")
            table = np.frombuffer(data, ">u4", n * len(own), at).astype(np.int64).reshape(n, len(own))
            column = lambda bit, k: table[:, own.index(bit)] if bit in own else np.full(n, values[k])
            sizes, marks = column(0x200, 1), column(0x400, 2).copy()
            if first is not None and n:
                marks[0] = first
            parts.append((place + np.cumsum(sizes) - sizes, sizes, marks & _NOT_SYNC == 0))
            ticks += int(column(0x100, 0).sum())
            place += int(sizes.sum())
    if not parts:
        return
    offsets, sizes, key = (np.concatenate(x) for x in zip(*parts))
    if len(offsets) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("samples outside of the file")
    for name, more in (("offsets", offsets), ("sizes", sizes), ("key", key)):
        track[name] = np.concatenate([track[name], more])
    track["ticks"] += ticks
    track["duration"] = max(track["duration"], track["ticks"])  # the header of a file in fragments may leave it open


def _compact(data: memoryview, at: int) -> np.ndarray:
    """Sizes of 4, 8 or 16 bits."""
    bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if bits not in (4, 8, 16) or n * bits // 8 > len(data):
        raise ValueError("a table of compact sizes that cannot be")
    if bits == 16:
        return np.frombuffer(data, ">u2", n, at + 12).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, -(-n * bits // 8), at + 12).astype(np.int64)
    return raw if bits == 8 else np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n]


def _table_of(data: memoryview, track: dict[str, tuple[int, int]]) -> dict:
    at = {name: start for name, (start, _) in track.items()}
    kind = bytes(data[at["hdlr"] + 8 : at["hdlr"] + 12]).decode("latin-1") if "hdlr" in at else ""
    (entries,) = struct.unpack_from(">I", data, at["stsd"] + 4)
    if not entries or at["stsd"] + 16 > track["stsd"][1]:
        raise ValueError("a track without a sample description")
    codec = bytes(data[at["stsd"] + 12 : at["stsd"] + 16]).decode("latin-1")
    head = at["mdhd"]
    scale, duration = struct.unpack_from(">IQ", data, head + 20) if data[head] == 1 else struct.unpack_from(">II", data, head + 12)
    if "stsz" in at or "stz2" not in at:
        fixed, n = struct.unpack_from(">II", data, at["stsz"] + 4)
        if (fixed or 4) * n > len(data):
            raise ValueError("more samples than the file can hold")
        sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, at["stsz"] + 12).astype(np.int64)
    else:
        sizes = _compact(data, at["stz2"])
        n = len(sizes)
    chunk_at = _rows(data, at["stco"], 1)[:, 0] if "stco" in at else _rows(data, at["co64"], 1, ">u8")[:, 0]
    per = _rows(data, at["stsc"], 3)
    counts = np.repeat(per[:, 1], np.diff(np.append(per[:, 0], len(chunk_at) + 1))) if len(per) else np.empty(0, np.int64)
    if len(counts) != len(chunk_at) or counts.sum() != n:
        raise ValueError("chunks and samples do not match")
    first = np.cumsum(counts) - counts
    before = np.concatenate([[0], np.cumsum(sizes)])
    offsets = np.repeat(chunk_at - before[first], counts) + before[:-1]
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("samples outside of the file")
    deltas = _rows(data, at["stts"], 2)
    key = np.ones(n, bool)
    if "stss" in at:
        which = _rows(data, at["stss"], 1)[:, 0]
        if len(which) and which.min() < 1:
            raise ValueError("samples count from 1")
        key[:] = False
        key[which - 1] = True
    return {"kind": kind, "codec": codec, "scale": scale, "duration": duration, "ticks": int((deltas[:, 0] * deltas[:, 1]).sum()), "offsets": offsets, "sizes": sizes, "key": key}


def main_track(found: list[dict]) -> dict:
    """The first track of pictures, or else of sound, or else the first."""
    if not found:
        raise ValueError("no track")
    return min(found, key=lambda t: {"vide": 0, "soun": 1}.get(t["kind"], 2))


def payload(data: memoryview, found: dict) -> bytes:
    """The samples' bytes, in order; neighbours are read together."""
    at, size = found["offsets"], found["sizes"]
    cuts = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1
    return b"".join(bytes(data[at[i] : at[j - 1] + size[j - 1]]) for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]) if j > i)


def feature(found: dict) -> str:
    key = found["key"]
    ranges = np.stack([found["offsets"][key], found["sizes"][key]])
    return f"{found['codec'].strip()} {found['duration']}/{found['scale']} samples={len(key)} keyframes={int(key.sum())} ranges={zlib.crc32(ranges.astype('<i8').tobytes()):08x}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), media (the file).

    Null texts count as empty ones, whose payload is 64 zeros. Equal texts give equal files; rows that
    repeat and rows without an id are each stored. Texts of any length that a column holds (2 GB) are
    stored whole, 64 files at a time. Other columns are ignored. No rows give no files.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                raw = [(t or "").encode("utf-8", "replace") for t in batch.column(1).slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 64), pa.array(map(len, raw), pa.int64()), pa.array([to_iso(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_RANGES = "array<struct<offset:long,length:long>>"
_PROBE = {
    "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "codec": "string", "duration": "double",
    "keyframes": _RANGES, "other_tracks": f"array<struct<kind:string,codec:string,duration:double,keyframes:{_RANGES}>>",
}


def _described(track: dict) -> dict:
    key = track["key"]
    ranges = [{"offset": a, "length": b} for a, b in zip(track["offsets"][key].tolist(), track["sizes"][key].tolist())]
    return {"kind": track["kind"], "codec": track["codec"], "duration": track["duration"] / track["scale"] if track["scale"] else None, "keyframes": ranges}


def probe(media: DataFrame, media_col: str = "media", with_payload: bool = True) -> DataFrame:
    """The other columns of `media`, and what the boxes of `media_col` say.

    codec, duration in seconds (null without a time scale), keyframe byte ranges and a feature line
    are those of the main track: the first of pictures, or else of sound; `other_tracks` has the rest.
    They come from the boxes alone; with `with_payload`, size, SHA-256 and the CRC-32 of the last 64
    bytes of the main track's samples as well. Null values give nulls; of bytes that are no such file,
    or a damaged one, only size and SHA-256 are known. A clashing column is replaced; rows that repeat
    stay. Files are read one at a time, whatever their size. Empty tables give empty results.
    """
    rest = [c for c in media.columns if c != media_col and c.lower() not in _PROBE]
    schema = ", ".join([*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in rest), *(f"{k} {v}" for k, v in _PROBE.items())])
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), ranges, pa.list_(pa.struct([("kind", pa.string()), ("codec", pa.string()), ("duration", pa.float64()), ("keyframes", ranges)]))]

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 10
        data = memoryview(raw)
        try:
            found = tables(data)
            main = main_track(found)
            body = payload(data, main) if with_payload else b""
        except (KeyError, ValueError, IndexError, OverflowError, RecursionError, struct.error):
            return (None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), *(None,) * 5)
        size = (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-PAD:])) if with_payload else (None,) * 3
        told = _described(main)
        return (*size, len(raw), hashlib.sha256(raw).hexdigest(), feature(main), told["codec"], told["duration"], told["keyframes"], [_described(t) for t in found if t is not main])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = [one(x.as_py()) for x in batch.column(len(rest)).slice(at, 64)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, 64) for i in range(len(rest))), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], names=[*rest, *_PROBE])

    return media.select(*(f"`{c}`" for c in (*rest, media_col))).mapInArrow(lambda batches: give_back(run(batches)), schema)
