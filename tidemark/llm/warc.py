"""Web archives: one gzip member per record, written by tasks and read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import reach_workers, stage
from tidemark.session import shared_folder

_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass(frozen=True)
class Writing:
    """``least``: payloads of fewer bytes are never revisits. ``date`` stands in every record, pages have none."""

    least: int = 0
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"


def _record(page_id, url: str | None, payload: bytes, sha1: bytes, owner, revisit: bool, how: Writing) -> bytes:
    label = base64.b32encode(sha1).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    address = "".join(c for c in url or "" if c not in "\r\n")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", how.date),
        ("WARC-Target-URI", address),
        ("WARC-Payload-Digest", f"sha1:{label}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[2:2] = [("WARC-Refers-To", f"<{_ID}{owner}>"), ("WARC-Profile", _PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + "\r\n"
    packer = zlib.compressobj(how.level, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str, how: Writing = Writing()) -> DataFrame:
    """Writes a record per row of (page_id, url, html) below ``folder``; returns (path, size) of the files.

    The payload is the html in UTF-8, null being empty. Of rows with equal payloads of ``how.least`` bytes or more, those
    with the largest page_id are responses and the others revisit it; a null page_id is never the largest, and where
    all are null all are responses. Which row that is comes from an aggregate on the payload's digest. Digests of several
    rows are stored before they are joined, so that both inputs of the join lie directly behind a shuffle and adaptive
    execution splits the rows of a common payload over tasks. Each attempt of a task writes files of its own; the returned list,
    which is stored with Spark's commit, names those of the attempts that count, so a lost executor leaves no half file
    in it.
    """
    reach_workers(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    owners = rows.groupBy("sha1").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("sha1", "owner")
    owned = rows.join(stage(owners, "owners"), "sha1", "left")
    # A payload that occurs once has no owner and is a response.
    other = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    revisit = other & (F.octet_length("payload") >= how.least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, size, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                record = _record(*row, how)
                out.write(record)
                size += len(record)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size])], ["path", "size"])

    written = owned.select("page_id", "url", "payload", "sha1", "owner", revisit.alias("revisit")).mapInArrow(run, "path string, size bigint")
    return stage(written, "archives")


class _Reader:
    """A file read forward in chunks, with one chunk held."""

    def __init__(self, file, size: int, chunk: int = 1 << 18) -> None:
        self.file, self.size, self.chunk, self.base, self.held = file, size, chunk, 0, b""

    def at(self, place: int) -> bytes:
        """Bytes from ``place`` on, some at least unless the file ends there."""
        if not self.base <= place < self.base + len(self.held):
            self.file.seek(place)
            self.base, self.held = place, self.file.read(min(self.chunk, self.size - place))
        return self.held[place - self.base : place - self.base + (1 << 14)]

    def find(self, place: int, stop: int) -> int | None:
        """The first gzip magic that starts in [place, stop)."""
        while place < stop:
            self.at(place)
            found = self.held.find(_MAGIC, place - self.base)
            if found >= 0:
                return self.base + found if self.base + found < stop else None
            # The magic may lie across the chunk's end.
            reached = self.base + len(self.held)
            if reached >= self.size:
                return None
            place = max(place, reached - len(_MAGIC) + 1)
            self.base, self.held = 0, b""
        return None

    def member(self, place: int) -> tuple[bytes, int] | None:
        """The decoded member that starts at ``place`` and the place behind it; None if it is no record."""
        unpacker, out, length = zlib.decompressobj(31), [], 0
        try:
            while not unpacker.eof:
                if not (data := self.at(place)):
                    return None
                out.append(unpacker.decompress(data))
                length += len(out[-1])
                place += len(data)
                if length >= 5 and not b"".join(out[:6])[:5] == b"WARC/":
                    return None
        except zlib.error:
            return None
        data = b"".join(out)
        return (data, place - len(unpacker.unused_data)) if data[:5] == b"WARC/" and b"\r\n\r\n" in data else None


def records(file, size: int, begin: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of every record whose member starts in [begin, end)."""
    reader, place = _Reader(file, size), begin
    while (place := reader.find(place, min(end, size))) is not None:
        found = reader.member(place)
        if found is None:
            place += 1
            continue
        data, behind = found
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
        fields = {k.strip().lower(): v.strip() for k, _, v in lines}
        length = fields.get("content-length", "")
        yield place, fields, rest[: int(length)] if length.isdigit() else rest
        place = behind


def read_warc(files: DataFrame, split: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """One row per record of the files (path, size): path, offset, record_type, record_id, target_uri, refers_to,
    payload_bytes, payload_digest and, if asked for, payload.

    Files are cut into ranges of ``split`` bytes which tasks read alone. A task looks for gzip magic in its range, takes
    a member as a record once it decodes to a WARC header, and owns the records that start inside; the last one may
    end beyond. Size and digest are those of the payload as read; for revisits, which hold none, what their fields say.
    Bytes that decode to no record are passed over. A file of size 0 has no records.
    """
    spark = files.sparkSession
    reach_workers(spark)
    begins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split).cast("bigint")))
    ranges = files.where("size > 0").select("path", "size", begins.alias("begin"))
    ranges = ranges.repartition(max(1, ranges.count()))
    schema = "path string, offset bigint, record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string"
    names = [part.split()[0] for part in schema.split(", ")] + ["payload"] * payloads
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, begin in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(place) as file:
                    for offset, fields, block in records(file, size, begin, begin + split):
                        kind = fields.get("warc-type", "")
                        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                        row = [path, offset, kind, *(fields.get(k) for k in ("warc-record-id", "warc-target-uri", "warc-refers-to"))]
                        if kind == "revisit":
                            length = fields.get("x-payload-length", "")
                            row += [int(length) if length.isdigit() else None, fields.get("warc-payload-digest", "").removeprefix("sha1:"), None]
                        else:
                            row += [len(payload), digest(payload), payload]
                        rows.append(row[: len(names)])
                        held += len(payload) + 200
                        if held > 1 << 22:
                            yield _batch(rows, kinds, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds, names)

    return ranges.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def _batch(rows: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def archived(spark: SparkSession, pages: DataFrame, how: Writing = Writing()) -> DataFrame:
    """Writes the pages into archives in the shared folder and reads those back: page_id, payload_bytes,
    payload_digest, record_type and refers_to (a page_id) of every record. An empty table gives no record."""
    files = write_warc(pages, shared_folder(spark, "warc"), how)
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<{_ID}(.*)>$', 1) as {kind.simpleString()})")
    return read_warc(files, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
