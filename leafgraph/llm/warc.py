"""WARC records in ZIP-packaged archives: a writer, and a reader that finds stored members by their directories and reads ranges."""

from __future__ import annotations

import base64
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.session import cut, delete, scratch, small_side

#: Bytes of compressed records after which an archive is closed, and bytes of neighbouring records that are read at once.
ARCHIVE_BYTES, READ_BYTES = 16_000_000, 2_000_000
#: Bytes of archives for each task that reads them.
TASK_BYTES = 64_000_000
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


# --- ZIP directories ---


def read_range(f, start: int, length: int) -> bytes:
    f.seek(start)
    data = f.read(length)
    if len(data) != length:
        raise ValueError(f"the archive ends within {start}+{length}")
    return bytes(data)


def zip_members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, where its data starts, packed size) from the central directory of the ZIP file f, ZIP64 or not.

    Only the tail, the directory and each member's local header are read.
    """
    tail_at = max(0, size - 65_557)
    tail = read_range(f, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    count, length, start = struct.unpack_from("<10xHII", tail, at)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        where = tail_at + at - 20
        signature, end64 = struct.unpack("<4s4xQ4x", read_range(f, where, 20)) if where >= 0 else (b"", 0)
        if signature == b"PK\x06\x07":
            signature, count, length, start = struct.unpack("<4s28xQQQ", read_range(f, end64, 56))
            if signature != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of the central directory where its locator points")
    directory, found, at = read_range(f, start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        flags, method, packed, plain, n_name, n_extra, n_note, local = struct.unpack_from("<8xHH8xIIHHH8xI", directory, at)
        raw = directory[at + 46 : at + 46 + n_name]
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only what is all ones in the entry, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        head = read_range(f, local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no local header where the directory points")
        n1, n2 = struct.unpack_from("<26xHH", head)
        found[raw.decode("utf-8" if flags & 0x800 else "cp437")] = (method, local + 30 + n1 + n2, packed)
        at += 46 + n_name + n_extra + n_note
    return found


# --- WARC records ---


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def warc_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record in a gzip member of its own. A revisit has the HTTP header but no payload."""
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else f"urn:page:{page}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def page_of(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def parse_record(data: bytes) -> dict:
    """page_id, record_type, digest, refers_to and, for a response, payload, of one unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of another length than its header says")
    kind, payload = fields["warc-type"], block.partition(b"\r\n\r\n")[2]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError("a payload that isn't what its digest says")
    return {"page_id": page_of(fields["warc-record-id"]), "record_type": kind, "digest": digest, "refers_to": page_of(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


# --- Jobs ---


def page_records(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, record_type, refers_to): which page's record holds a payload and which only refer to it.

    Of pages with equal payloads of at least `least` bytes, the one with the largest page_id is a response and the others
    revisit it; smaller payloads are all responses. A null html is an empty payload. Rows that repeat the largest page_id
    are responses too; a null page_id is below all others. Only digests are shuffled; the groups of equal payloads, a row
    each, are broadcast if they are few and joined by a shuffle if not.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.when(F.length("payload") >= least, F.sha1("payload")))
    shared = rows.where("sha1 is not null").groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(small_side(cut(shared.withColumn("shared", F.lit(True)))), "sha1", "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """(path, size, records) of the ZIP archives written to folder, which all executors must see.

    An archive has two stored members, the gzipped records and their index, and holds about ARCHIVE_BYTES. Names are
    new in each attempt of a task and only a finished task's archives are listed, so a lost task leaves no wrong rows.
    """
    def close(parts: list[bytes], index: list[str]) -> tuple[str, int, int]:
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_STORED) as z:
            for name, data in ((RECORDS, b"".join(parts)), (INDEX, "".join(index).encode())):
                z.writestr(zipfile.ZipInfo(name), data)
        target, path = fs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}.wacz")
        with target.open_output_stream(path) as out:
            out.write(body.getbuffer())
        return path, len(body.getbuffer()), len(parts)

    def run(batches):
        parts, index, at = [], [], 0
        done = []
        for batch in batches:
            for page, url, payload, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(warc_record(page, url, payload, refers, kind == "revisit"))
                index.append(json.dumps({"offset": at, "length": len(parts[-1])}) + "\n")
                at += len(parts[-1])
                if at >= ARCHIVE_BYTES:
                    done.append(close(parts, index))
                    parts, index, at = [], [], 0
        if parts:
            done.append(close(parts, index))
        columns = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["path", "size", "records"])

    return records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, "path string, size long, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, record_type, digest, refers_to, payload) of every record in the archives (path, size) of folder's file system.

    First each archive's directory and index member are read, which gives ranges of neighbouring records; then the
    ranges are dealt to tasks, which read just these bytes. Rows that name archives are short and stand for much data, so
    both are dealt to a number of tasks that is counted from the archives' bytes. A record whose length or digest is wrong
    raises ValueError.
    """
    count, total = archives.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    def ranges(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.FileSystem.from_uri(folder)[0].open_input_file(path) as f:
                    members = zip_members(f, size)
                    if any(members[m][0] != 0 for m in (RECORDS, INDEX)):
                        raise ValueError(f"{path}: members must be stored")
                    base, run, held = members[RECORDS][1], [], 0
                    for line in read_range(f, *members[INDEX][1:]).splitlines():
                        entry = json.loads(line)
                        if run and held + entry["length"] > READ_BYTES:
                            out.append((path, base + run[0][0], [n for _, n in run]))
                            run, held = [], 0
                        run.append((entry["offset"], entry["length"]))
                        held += entry["length"]
                    if run:
                        out.append((path, base + run[0][0], [n for _, n in run]))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "lengths"), x, strict=True)) for x in out], pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.FileSystem.from_uri(folder)[0].open_input_file(path) as f:
                    data = read_range(f, start, sum(lengths))
                rows, at = [], 0
                for length in lengths:
                    rows.append(parse_record(zlib.decompress(data[at : at + length], 31)))
                    at += length
                yield pa.RecordBatch.from_pylist(rows, kinds)

    kinds = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    found = archives.select("path", "size").repartition(max(1, min(tasks, count))).mapInArrow(ranges, "path string, start long, lengths array<long>")
    return found.repartition(max(1, min(tasks, count + total // READ_BYTES))).mapInArrow(read, "page_id long, record_type string, digest string, refers_to long, payload binary")


def archive_round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, as read back from archives just written.

    See page_records for ties, nulls and repeats. A revisit's payload_bytes come from the response with its digest.
    No pages give no archives and no rows.
    """
    folder = scratch(spark, "warc")
    target, path = fs.FileSystem.from_uri(folder)
    target.create_dir(path, recursive=True)
    archives = cut(write_archives(page_records(pages, least), folder))
    rows = cut(read_archives(archives, folder).select("page_id", "record_type", "digest", "refers_to", F.length("payload").cast("long").alias("bytes")))
    delete(spark, folder)
    revisits = rows.where("record_type = 'revisit'")
    sizes = rows.where("record_type = 'response'").select("digest", F.col("bytes").alias("full")).dropDuplicates(["digest"])
    needed = cut(sizes.join(revisits.select("digest").distinct(), "digest", "left_semi"))
    full = rows.join(small_side(needed), "digest", "left")
    return full.select("page_id", F.coalesce("bytes", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
