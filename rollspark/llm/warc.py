"""WARC archives as seekable Zstandard bundles.

Records are packed into independent Zstandard frames of about ``FRAME`` bytes, so
that one record is read by decompressing one frame. A bundle ends with the seek
table of the seekable format (a skippable frame with the sizes of all frames), and
an index maps record identifiers to a frame and the offset in it. Any Zstandard
reader can read a bundle from start to end as a ``.warc.zst`` file.

Of records with equal payloads of at least ``SMALL`` bytes, the one with the
smallest key is a response and the others are revisits, which refer to it and carry
no payload; repeated rows that share the smallest key are all responses. A row with
a null key refers to its group's smallest key if there is one. Null payloads are
empty, null addresses are left out. Extra columns are ignored.

Bundles are written as rows of a table in the shared folder, so that lost tasks
leave nothing behind; ``export`` makes files of them.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rollspark.llm.common import attach, store

SMALL = 100
FRAME = 256 << 10
BUNDLE = 16 << 20  # bytes of records, before compression

# Fixed values of the seekable format: magic numbers of its skippable frame and of its footer.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
# Fixed value of the archive format: profile of a revisit with the same payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLES = "bundle_id string, bundle binary, index array<struct<record_id: long, frame: int, offset: long, length: long>>"
INDEX = pa.list_(pa.struct([("record_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"


def record(key: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; ``payload`` is left out of a revisit."""
    revisit = refers_to is not None
    block = b"" if revisit else HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {SAME_PAYLOAD}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Packs records into frames; ``done`` gives the bundle and its index."""

    def __init__(self, level: int = 3):
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.open, self.held, self.total = [], 0, 0

    def add(self, key: int | None, data: bytes) -> None:
        self.index.append({"record_id": key, "frame": len(self.frames), "offset": self.held, "length": len(data)})
        self.open.append(data)
        self.held += len(data)
        self.total += len(data)
        if self.held >= FRAME:
            self._close()

    def _close(self) -> None:
        if self.open:
            frame = self.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.open, self.held = [], 0

    def done(self) -> tuple[bytes, list[dict]]:
        self._close()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        table = struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        return b"".join(self.frames) + table, self.index


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, bundle: bytes):
        count, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if descriptor & 0x80 else 8  # with or without checksums
        begin = len(bundle) - 9 - count * width
        self.bundle, self.starts, at = bundle, [], 0
        for i in range(count):
            packed, size = struct.unpack_from("<II", bundle, begin + i * width)
            self.starts.append((at, packed, size))
            at += packed
        self.decompress = zstandard.ZstdDecompressor().decompress

    def frame(self, number: int) -> bytes:
        at, packed, size = self.starts[number]
        return self.decompress(self.bundle[at : at + packed], max_output_size=size)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def parsed(data: bytes) -> dict:
    """Headers of a record, and its payload (None in a revisit)."""
    head, block = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    fields["payload"] = block.split(b"\r\n\r\n", 1)[1] if fields["WARC-Type"] == "response" else None
    return fields


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """6. Write all pages as records into bundles; the stored table of bundles with their index. Keys are integers."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    groups = rows.filter(F.col("size") >= SMALL).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = store(groups.filter("n > 1"), "payloads")
    known = attach(rows, groups, "digest", "n")
    refers_to = F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    known = known.select("key", "url", F.when(refers_to.isNull(), F.col("payload")).alias("payload"), "digest", "size", refers_to.alias("refers_to"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, writer = TaskContext.get().partitionId(), 0, BundleWriter()

        def row() -> pa.RecordBatch:
            bundle, index = writer.done()
            columns = [pa.array([f"{part:06d}-{made:06d}"]), pa.array([bundle], pa.binary()), pa.array([index], INDEX)]
            return pa.RecordBatch.from_arrays(columns, names=["bundle_id", "bundle", "index"])

        for batch in batches:
            for k, u, p, d, s, r in zip(*[c.to_pylist() for c in batch.columns]):
                writer.add(k, record(k, u, p or b"", d, s, r))
                if writer.total >= BUNDLE:
                    yield row()
                    made, writer = made + 1, BundleWriter()
        if writer.total:
            yield row()

    return store(known.mapInArrow(packed, BUNDLES), "bundles")


RECORDS = "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string"


def records(bundles: DataFrame) -> DataFrame:
    """6. Read all records of the bundles by index and seek table; sizes and digests of responses are those of the bytes read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, index in zip(batch.column(0), batch.column(1)):
                reader, by_frame = BundleReader(bundle.as_py()), defaultdict(list)
                for entry in index.as_py():
                    by_frame[entry["frame"]].append(entry)
                out: list[tuple] = []
                for number, entries in by_frame.items():
                    data = reader.frame(number)
                    for e in entries:
                        fields = parsed(data[e["offset"] : e["offset"] + e["length"]])
                        body, refers = fields["payload"], fields.get("WARC-Refers-To")
                        size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if body is not None and (len(body), hashlib.sha256(body).hexdigest()) != (size, digest):
                            raise ValueError(f"record {e['record_id']} is damaged")
                        refers = int(refers.removeprefix("<urn:page:")[:-1]) if refers else None
                        out.append((e["record_id"], size, digest, fields["WARC-Type"], refers, fields.get("WARC-Target-URI")))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                names = [part.split()[0] for part in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return bundles.select("bundle", "index").mapInArrow(read, RECORDS)


def payloads(bundles: DataFrame, wanted: DataFrame, key: str = "page_id") -> DataFrame:
    """6. Payloads of the records with the keys of ``wanted``: only their bundles are read, and of these only their frames."""
    entries = bundles.select("bundle_id", F.explode("index").alias("at")).join(wanted.select(key).distinct(), F.col("at.record_id") == F.col(key), "left_semi")
    asked = entries.groupBy("bundle_id").agg(F.collect_list("at").alias("asked"))  # no more than the bundle's index

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, index in zip(batch.column(0), batch.column(1)):
                reader = BundleReader(bundle.as_py())
                found = [(e["record_id"], parsed(reader.record(e["frame"], e["offset"], e["length"]))["payload"]) for e in index.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], names=["record_id", "payload"])

    return bundles.join(asked, "bundle_id").select("bundle", "asked").mapInArrow(read, "record_id long, payload binary")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """6. Write each bundle as a file below ``folder``, a URI that all executors reach; path and size of each.

    A file gets its name when it is whole, so a task that runs twice leaves the same files.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        for batch in batches:
            paths, sizes = [], []
            for name, bundle in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{root}/{name}.warc.zst"
                with system.open_output_stream(f"{path}.{TaskContext.get().taskAttemptId()}") as out:
                    out.write(bundle)
                system.move(f"{path}.{TaskContext.get().taskAttemptId()}", path)
                paths.append(path)
                sizes.append(len(bundle))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return store(bundles.select("bundle_id", "bundle").mapInArrow(written, "path string, bytes long"), "exported")
