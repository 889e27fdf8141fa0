"""WARC records in ZIP packages: written by tasks, found through the ZIP directories, read by range.

A package holds ``archive/data.warc`` and ``indexes/index.cdxj`` as stored members, so the bytes of a
record lie in the file as they are. The reader parses the end record, the ZIP64 locator and end record
and the central directory, finds the members, and reads each record by its offset and length.

Packages live in the shared folder and are opened through pyarrow.fs, so any store it knows will do. A
package's name holds the task attempt; only packages named in the written manifest count.

Of records with equal payloads of at least ``min_revisit`` bytes, the largest page_id is the response.
Defined cases: null html is an empty payload; a null url is written without a target; rows alike in
page_id and payload are all responses if that page_id is the largest, else all revisits; rows with a
null page_id are responses unless an equal payload has a page_id; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize, scratch_dir, split_by_keys

#: A package is closed once its records reach this size.
PACKAGE_BYTES = 64 << 20
_DATA, _INDEX = "archive/data.warc", "indexes/index.cdxj"
_READ = 4 << 20


def assign_records(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, url, payload, sha1, refers_to of every page; html moves only where a revisit is possible."""
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    rows = rows.withColumn("row_key", F.xxhash64("page_id", "sha1"))
    digests = materialize(rows.select("page_id", "sha1", "row_key", F.octet_length("payload").alias("size")), "payload-digests")
    large = digests.filter(F.col("size") >= min_revisit)
    groups = large.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    groups = materialize(groups, "payload-groups")
    spread = F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    found = join_groups(large, groups, "sha1", "n", digests.count(), spread)
    revisits = found.filter(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = materialize(revisits.select("row_key", "refers_to").distinct(), "revisits")
    maybe, surely_not = split_by_keys(rows, revisits, "row_key", revisits.count())
    return surely_not.withColumn("refers_to", F.lit(None).cast("long")).unionByName(maybe.join(revisits, "row_key", "left").select(*surely_not.columns, "refers_to")).drop("row_key")


def _record(page_id, url, payload: bytes, refers_to) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    head += [f"WARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    head += [] if url is None else [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"]
    head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += payload
    else:
        head += [f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_packages(rows: DataFrame, folder: str) -> DataFrame:
    """Write all rows into packages below ``folder``; the manifest (path, records) is a written table."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context, made, open_ = TaskContext.get(), [], None

        def close():
            package, data, sink, index, path = open_
            data.close()
            with package.open(_INDEX, "w", force_zip64=True) as f:
                f.write("".join(json.dumps({"offset": a, "length": n}) + "\n" for a, n in index).encode())
            package.close()
            sink.close()
            made.append((path, len(index)))

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                if open_ is None:
                    path = f"{root}/part-{context.partitionId()}-{context.taskAttemptId()}-{len(made)}.zip"
                    sink, at = store.open_output_stream(path), 0
                    package = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                    open_ = package, package.open(_DATA, "w", force_zip64=True), sink, [], path
                record = _record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                open_[1].write(record)
                open_[3].append((at, len(record)))
                at += len(record)
                if at >= PACKAGE_BYTES:
                    close()
                    open_ = None
        if open_ is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["path", "records"])

    return materialize(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long"), "manifest")


def central_directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Name -> (method, offset of the member's bytes, length), from the end records and central directory."""
    tail_at = max(0, size - 66_000)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP package")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if tail[end - 20 : end - 16] == b"PK\x06\x07":
        end64 = f.read_at(56, struct.unpack("<Q", tail[end - 12 : end - 4])[0])
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", end64[32:56])
    directory, at, members = f.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full, n_name, n_extra, n_comment = *struct.unpack("<H", directory[at + 10 : at + 12]), *struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        local = struct.unpack("<I", directory[at + 42 : at + 46])[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        packed, local = _zip64(extra, full, packed, local)
        header = f.read_at(30, local)
        if header[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        members[name] = method, local + 30 + sum(struct.unpack("<HH", header[26:30])), packed
        at += 46 + n_name + n_extra + n_comment
    return members


def _zip64(extra: bytes, full: int, packed: int, local: int) -> tuple[int, int]:
    """Packed size and local offset, taken from the ZIP64 field where the 32-bit ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            wide = list(struct.unpack(f"<{n // 8}Q", extra[at + 4 : at + 4 + n // 8 * 8]))
            if full == 0xFFFFFFFF:
                wide.pop(0)
            packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
            local = wide.pop(0) if local == 0xFFFFFFFF else local
        at += 4 + n
    return packed, local


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    page_id = int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None
    if fields["WARC-Type"] == "revisit":
        return page_id, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", int(fields["X-Refers-To-Page"])
    payload = block.partition(b"\r\n\r\n")[2]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
        raise ValueError(f"payload of page {page_id} does not match its digest")
    return page_id, len(payload), digest, "response", None


def read_index(f, members: dict) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of every record, from the stored index read in ranges."""
    method, at, size = members[_INDEX]
    if method or members[_DATA][0]:
        raise ValueError("members are compressed; records cannot be read by range")
    rest, data = b"", members[_DATA][1]
    for a in range(at, at + size, _READ):
        *lines, rest = (rest + f.read_at(min(_READ, at + size - a), a)).split(b"\n")
        for line in lines:
            entry = json.loads(line)
            yield data + entry["offset"], entry["length"]


def read_packages(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the packages named in ``manifest``."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as f:
                    rows = []
                    for at, length in read_index(f, central_directory(f, f.size())):
                        rows.append(_parse(f.read_at(length, at)))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    paths = manifest.select("path").repartition(max(1, min(10_000, manifest.count())), "path")
    return paths.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_revisit: int = 0, folder: str | None = None) -> DataFrame:
    """Write the pages into packages in the shared folder and read them back."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{scratch_dir(spark)}/packages-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    manifest = write_packages(assign_records(pages, min_revisit), folder)
    return read_packages(manifest, folder)
