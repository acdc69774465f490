"""WARC archives as seekable Zstandard bundles.

Every page becomes one WARC record. Equal payloads of at least ``LEAST`` bytes are stored once, in the record of the
smallest page_id; the others are revisit records that refer to it. Records go into independent Zstandard frames of about
``FRAME`` bytes, frames into bundles of about ``BUNDLE`` bytes, and each bundle ends with a seek table (the skippable frame
of the seekable Zstandard format), so it stays a valid .warc.zst. An index maps a record to its bundle, its frame and its
place inside the frame; a reader decompresses that frame only.

Bundles are rows of a table in the shared folder (bytes in one column), which any store that Spark writes can hold; a lost
task is written again by Spark. ``export`` puts them into files of a folder that all executors mount.

Defined cases: null html is an empty payload; null url gives an empty target; rows of one page_id with different html are
separate records; a null page_id is a response; repeated rows of
the smallest page_id are responses, each of them; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourpanel.session import materialise

from .common import slices

LEAST = 100
FRAME = 256 << 10
BUNDLE = 8 << 20
#: Fixed values of the seekable format: skippable frame, its footer's magic number.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

_BUNDLE = "bundle string, body binary"
_INDEX = "record_id string, bundle string, frame int, at int, size int"


def record(record_id: str, url: str, payload: bytes, digest: str, refers_to: int | None, page_id: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload, only its length and digest."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id}>",
        "WARC-Target-URI: " + " ".join(url.split()), "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    body = b"" if revisit else payload
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(named["Content-Length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    return named, rest[:n]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", packed, plain) for packed, plain in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(body: bytes) -> list[tuple[int, int]]:
    """(start, compressed size) of every frame, from the end of the bundle."""
    n, flags, magic = struct.unpack("<IBI", body[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    frames, at = [], 0
    for packed, _ in struct.iter_unpack("<II", body[-9 - 8 * n : -9]):
        frames.append((at, packed))
        at += packed
    return frames


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind bundle and of kind index, made record by record; one open bundle is held."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=6).compress
    from pyspark import TaskContext

    number, task = 0, TaskContext.get().partitionId()
    frames, sizes, open_, index = [], [], [], []
    schema = pa.schema([("bundle", pa.string()), ("body", pa.binary()), ("record_id", pa.string()), ("frame", pa.int32()), ("at", pa.int32()), ("size", pa.int32())])

    def close_frame() -> None:
        if open_:
            plain = b"".join(open_)
            frames.append(pack(plain))
            sizes.append((len(frames[-1]), len(plain)))
            open_.clear()

    def close_bundle() -> pa.RecordBatch:
        nonlocal number
        close_frame()
        name = f"part-{task:06d}-{number:06d}.warc.zst"
        number += 1
        body = b"".join([*frames, seek_table(sizes)])
        rows = [(name, body, None, None, None, None), *[(name, None, *r) for r in index]]
        for kept in (frames, sizes, index):
            kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in slices(batches, "payload", 8 << 20):
        for r in batch.to_pylist():
            raw = record(r["record_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"], r["page_id"])
            index.append((r["record_id"], len(frames), sum(map(len, open_)), len(raw)))
            open_.append(raw)
            if sum(map(len, open_)) >= FRAME:
                close_frame()
                if sum(n for n, _ in sizes) >= BUNDLE:
                    yield close_bundle()
    if index:
        yield close_bundle()


def records(pages: DataFrame) -> DataFrame:
    """record_id, page_id, url, payload, payload_digest, refers_to (null for a response)."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    large = rows.where(F.octet_length("payload") >= LEAST)
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("digest"), "first")
    both = rows.join(first, F.col("payload_digest") == F.col("digest"), "left")
    refers = F.when(F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return both.select(F.expr("uuid()").alias("record_id"), "page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def write(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The archive as two tables: bundles (bundle, body), index (record_id, bundle, frame, at, size)."""
    made = records(pages).mapInArrow(_bundles, "bundle string, body binary, record_id string, frame int, at int, size int")
    stored = materialise(made, "warc")
    return stored.where("body is not null").select("bundle", "body"), stored.where("body is null").select("record_id", "bundle", "frame", "at", "size")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finds every record by its index entry; a frame is decompressed once per bundle row."""
    import zstandard

    names = ["record_id", "page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    for batch in batches:
        for body, entries in zip(batch.column("body"), batch.column("entries"), strict=True):
            body, frames, opened, out, held = body.as_py(), None, {}, [], 0
            frames = read_seek_table(body)
            for e in sorted(entries.as_py(), key=lambda e: (e["frame"], e["at"])):
                if e["frame"] not in opened:
                    start, n = frames[e["frame"]]
                    opened = {e["frame"]: zstandard.ZstdDecompressor().decompress(body[start : start + n])}
                head, payload = parse(opened[e["frame"]][e["at"] : e["at"] + e["size"]])
                kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                if kind == "response":
                    size = len(payload)
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("payload does not match its digest")
                number = lambda key, h=head: int(h[key]) if h.get(key) else None
                if e["record_id"] != head["WARC-Record-ID"][10:-1]:
                    raise ValueError("index points to another record")
                out.append((e["record_id"], number("X-Page-ID"), head["WARC-Target-URI"], kind, payload, size, digest, number("X-Refers-To-Page-ID")))
                held += len(payload)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def read(bundles: DataFrame, index: DataFrame) -> DataFrame:
    """Records named by ``index`` (all, or the wanted ones), read from ``bundles`` by seeking to their frames."""
    entries = index.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "at", "size")).alias("entries"))  # bounded by a bundle
    return bundles.join(entries, "bundle").select("body", "entries").mapInArrow(
        _read, "record_id string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archive."""
    return read(*write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Puts every bundle into a file of ``folder`` (mounted on all executors); a file appears whole or not at all."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                part = os.path.join(folder, f".{r['bundle']}-{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(r["body"])
                os.replace(part, os.path.join(folder, r["bundle"]))
            yield pa.RecordBatch.from_arrays([batch.column("bundle"), pa.array([len(b.as_py()) for b in batch.column("body")], type=pa.int64())], names=["bundle", "size"])

    return bundles.mapInArrow(put, "bundle string, size long")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM s WHERE payload_bytes >= {LEAST} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM s LEFT JOIN f USING (payload_digest)
"""
