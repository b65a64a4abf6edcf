"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC records, followed by a skippable
frame with the seek table (compressed and decompressed size of every frame, then the count and a magic number).
The index maps a record identifier to (bundle, frame, offset in the frame, length), so one record costs one
ranged read and one frame's decompression.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versewise.llm.scratch import bound_batches, cut, scratch_path
from versewise.llm.token_store import write_file

# Fixed values of the seekable format and of WARC 1.1.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Revisits up to this many rows (about 60 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
INDEX = "record_id string, page_id long, bundle string, frame int, frame_start long, offset long, length long"
RECORDS = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}"


def make_record(page_id, url, payload: bytes, revisit: bool, refers_to) -> tuple[str, bytes]:
    """(record identifier, bytes of the record). A revisit keeps the digest and length but not the payload."""
    digest = base32_sha1(payload)
    own = record_id(page_id, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{own}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return own, "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at ``at`` (columns of RECORDS) and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    start, size = end + 4, int(fields["Content-Length"])
    block = data[start : start + size]
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else block[block.index(b"\r\n\r\n") + 4 :]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and base32_sha1(payload) != digest:
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields and fields[k] != "None" else None
    row = {"record_id": fields["WARC-Record-ID"][1:-1], "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload}
    return row, start + size + 4


class Bundle:
    """Collects records into frames of about ``frame_bytes`` and closes with the seek table."""

    def __init__(self, name: str, frame_bytes: int, level: int):
        import zstandard

        self.name, self.frame_bytes = name, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.done, self.sizes, self.open, self.open_bytes, self.index, self.bytes = [], [], [], 0, [], 0

    def add(self, page_id, own: str, record: bytes) -> None:
        self.index.append((own, page_id, self.name, len(self.sizes), self.bytes, self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        frame = self.zip.compress(b"".join(self.open))
        self.done.append(frame)
        self.sizes.append((len(frame), self.open_bytes))
        self.bytes += len(frame)
        self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        if self.open:
            self._close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join(self.done) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of every frame, from the footer."""
    n, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - i))
        out.append((at, packed, plain))
        at += packed
    return out


def frame_bytes(data: bytes, frame: int) -> bytes:
    """One frame's records, without touching the others."""
    import zstandard

    at, packed, plain = seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=plain)


def plan_revisits(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the rows that revisit another record with an equal payload.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the largest page_id are responses
    (a null page_id is the least; several rows with the largest one are all responses); the others revisit it.
    Only digests and ids are shuffled, and groups are combined before the shuffle.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    marks = pages.select(F.col(id_col).alias("page_id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= min_bytes)
    groups = marks.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return marks.join(groups, "digest").where("not (page_id <=> refers_to)").select("page_id", "digest", "refers_to").distinct()


def write_bundles(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, bundle_bytes: int = 32 << 20, frame_size: int = 256 << 10, level: int = 3) -> str:
    """Write a record per row to bundles below ``folder`` and an index beside them; returns the folder.

    Null body is the empty payload. A bundle holds about ``bundle_bytes`` of compressed frames, a frame about
    ``frame_size`` bytes of records (a longer record is a frame of its own); tasks hold one open bundle. The
    pages themselves are not shuffled while the revisits are few enough to broadcast (their count is checked).
    An empty table writes an empty index.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    revisits = cut(plan_revisits(pages, id_col, body_col, min_bytes), "revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("body")).withColumn("digest", F.sha1("body")).alias("p")
    match = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest"))
    rows = rows.join(revisits.alias("r"), match, "left").select("p.page_id", "p.url", "p.body", F.col("r.digest").isNotNull().alias("revisit"), "r.refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, bundle = TaskContext.get().partitionId(), 0, None
        names = [x.split()[0] for x in INDEX.split(", ")]

        def flush() -> pa.RecordBatch:
            write_file(folder, bundle.name, bundle.finish())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*bundle.index), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names)

        for batch in batches:
            ids, urls, bodies, revs, refs = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                if bundle is None:
                    bundle = Bundle(f"bundle-{task:08d}-{n:06d}.warc.zst", frame_size, level)
                    n += 1
                own, record = make_record(ids[i].as_py(), urls[i].as_py(), bodies[i].as_py(), revs[i].as_py(), refs[i].as_py())
                bundle.add(ids[i].as_py(), own, record)
                if bundle.bytes >= bundle_bytes:
                    yield flush()
                    bundle = None
        if bundle is not None:
            yield flush()

    bound_batches(spark)
    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/_index")
    return folder


def read_index(spark, folder: str) -> DataFrame:
    """Where each record is: record identifier -> bundle, frame, start of the frame, offset in it, length."""
    return spark.read.schema(INDEX).parquet(f"{folder}/_index")


def read_bundles(spark, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles in ``folder``, parsed from the archives (columns of RECORDS).

    Frames are decompressed one at a time and payload digests are verified. A bundle's name is its task's and
    its bytes depend on its rows alone, so attempts that were lost leave no other files.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                data = data.as_buffer().to_pybytes()
                for k in range(len(seek_table(data))):
                    frame, at, rows = frame_bytes(data, k), 0, []
                    while at < len(frame):
                        row, at = parse_record(frame, at)
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "bundle-*.warc.zst").load(folder)
    return files.select("content").mapInArrow(read, RECORDS)


def fetch_record(folder: str, bundle: str, frame_start: int, offset: int, length: int) -> dict:
    """One record by its index entry, with one ranged read."""
    import zstandard
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    with where.open_input_file(f"{base}/{bundle}") as f:
        f.seek(frame_start)
        reader = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=False)
        reader.read(offset)
        return parse_record(reader.read(length))[0]
