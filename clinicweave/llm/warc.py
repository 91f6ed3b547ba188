"""Web archives (WARC) with Zstandard dictionaries, written and read as rows of whole archives.

An archive is one binary value: a leading skippable frame with a dictionary built from the archive's
own records (trained, or their beginnings where they are too few to train on), then one frame per record, so that any record can be read alone. Archives close at a
bounded size and go through Spark's own writer, so a lost task leaves no half archive behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, write_table

SKIPPABLE = 0x184D2A5D
LEAST = 1000  # bytes of payload from which an equal one is a revisit
SPREAD = 32  # tasks over which the copies of one payload are dealt
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to) -> bytes:
    """One WARC record: a response, or a revisit without its payload."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split()) or 'urn:none'}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary of about `size` bytes; of samples too few or too small to train on, their beginnings, an eighth of them at most."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total > 4 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:  # the samples have too little in common
            pass
    each = max(64, min(size, total // 8) // max(1, len(samples)))
    return b"".join(x[:each] for x in samples)[:size]


def archive(records: list[bytes], dict_bytes: int = 32_768, sample_bytes: int = 2_000_000, level: int = 3) -> bytes:
    """One archive: a dictionary built from its own records in a leading skippable frame, then a frame for each record."""
    step = max(1, sum(map(len, records)) // sample_bytes)
    raw = dictionary([r[:65_536] for r in records[::step]], dict_bytes)
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *(press.compress(r) for r in records)])


def records(data: bytes):
    """The records of an archive, one frame after the other."""
    trained, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        (size,) = struct.unpack_from("<I", data, 4)
        trained, at = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size
    press = zstandard.ZstdDecompressor(dict_data=trained)
    while at < len(data):
        frame = press.decompressobj()
        text = frame.decompress(data[at:] if at + 200_000 > len(data) else data[at : at + 200_000])
        end = min(len(data), at + 200_000)
        while not frame.eof:
            if end >= len(data):
                raise ValueError("an archive ends inside a frame")
            text += frame.decompress(data[end : end + 1_000_000])
            end = min(len(data), end + 1_000_000)
        at = end - len(frame.unused_data)
        yield text


def parse(text: bytes) -> dict:
    """Headers of a record, the payload's size and digest, and the payload itself.

    A response's size and digest are those of the payload read, which must equal the stated ones; a
    revisit has no payload and gives what it states.
    """
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    sha1 = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if fields["WARC-Type"] == "response":
        stated, size, sha1 = (size, sha1), len(payload), hashlib.sha1(payload).hexdigest()
        if (size, sha1) != stated:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not the one that its headers state")
    return fields | {"size": size, "sha1": sha1, "payload": payload}


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, archive_bytes: int = 16_000_000) -> DataFrame:
    """Rows (n_records, archive): every page's record, in archives of about `archive_bytes` each.

    Of pages with equal payloads of at least `least` bytes, the one with the largest id is the
    response and the others revisit it; smaller ones, null and empty ones are responses. Rows that
    repeat an id are each written; a page without an id never is what others refer to. A page of any
    length is one record, held whole by one task beside the archive it goes to. Clashing columns are
    ignored. No pages give no archives.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("body"))
    rows = rows.withColumn("sha1", F.sha1("body"))
    kept = rows.where(F.length("body") >= least).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("sha1", "first")
    kept = write_table(kept, "payloads")
    count = kept.count()
    large, small_ones = rows.where(F.length("body") >= least), rows.where(F.length("body") < least)  # small and empty ones never meet in a task
    if count * 80 <= BROADCAST_BYTES:
        large = large.join(F.broadcast(kept), "sha1", "left")
    else:  # copies of one payload go to many tasks
        part = F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD)).cast("int")
        large = large.withColumn("part", part).join(kept.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["sha1", "part"], "left")
    large = large.select("page_id", "url", "body", "sha1", F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first")).alias("refers_to"))
    rows = large.union(small_ones.select("page_id", "url", "body", "sha1", F.lit(None).cast("long")))

    def run(batches):
        held, size, close = [], 0, lambda: pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([archive(held)], pa.binary())], names=["n_records", "archive"])
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                for row in zip(*(c.slice(at, 100).to_pylist() for c in batch.columns)):
                    held.append(record(*row))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield close()
                        held, size = [], 0
        if held:
            yield close()

    return rows.select("page_id", "url", "body", "sha1", "refers_to").mapInArrow(run, "n_records long, archive binary")


def read_archives(archives: DataFrame, archive_col: str = "archive") -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html.

    html is null for revisits. Null and empty archives give no rows; a damaged one fails the job.
    Records that repeat are each returned, in batches of 500 or about 8 MB of payload. Other columns
    are ignored.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for text in records(data.as_py()) if data.is_valid else ():
                    f = parse(text)
                    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
                    kind = f["WARC-Type"]
                    rows.append((number(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["size"], f["sha1"], kind, number(f.get("WARC-Refers-To")), f["payload"].decode("utf-8", "replace") if kind == "response" else None))
                    held += len(f["payload"])
                    if len(rows) == 500 or held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return archives.select(archive_col).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
