"""WARC archives: written with one gzip member a record, read back sequentially.

Writing. The smallest id of each payload that several records share is found by
a grouped minimum over digests (narrow rows, combined map-side). Each record is
compressed where it is read, and only the compressed member is shuffled to meet
its digest's smallest id; a record that repeats a payload of another then leaves
just a revisit record. Every task writes archives of bounded size into the
shared folder under names of its own and returns their paths; paths of failed
attempts are never read.

Reading. An archive is read in small blocks; zlib inflates one member at a time,
headers are parsed as soon as they are complete, the block is framed by
Content-Length, and its payload's SHA-256 is compared with the header's.

Defined cases: a null or empty payload is an empty response; payloads of fewer
bytes than ``least`` are never revisits; rows with the same smallest id are all
responses; a null id counts as larger than any and is refers_to of none; null
URLs are left out of the header; payloads of any length are written whole and
must fit a row of Spark; an empty table gives an empty result; only the id, URL
and payload columns are read, so other columns and their names do not matter.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, scratch_dir

#: Least payload that a revisit record stands for.
LEAST_REVISIT = 100
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16
URN = "urn:page:"

RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, verified boolean"


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member that holds one record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _fields(kind: str, page_id: int | None, url: str | None, digest: str) -> list[tuple[str, str]]:
    out = [("WARC-Type", kind), ("WARC-Record-ID", f"<{URN}{'null' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        out.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    return [*out, ("WARC-Payload-Digest", f"sha256:{digest}")]


def response(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member([*_fields("response", page_id, url, digest), ("Content-Type", "application/http; msgtype=response")], http + payload)


def revisit(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int) -> bytes:
    more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{URN}{refers_to}>"), ("Payload-Length", str(size))]
    return member([*_fields("revisit", page_id, url, digest), *more], b"")


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Write one record for each row; the archives written, ``(path, records, bytes)``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    shared = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, url, text, digest in zip(batch["page_id"].astype(object), batch["url"], batch["html"], batch["digest"]):
                payload = text.encode("utf-8", "replace")
                page_id = None if pd.isna(page_id) else int(page_id)
                out.append((page_id, url, digest, len(payload), response(page_id, url, payload, digest)))
            yield pd.DataFrame(out, columns=["page_id", "url", "digest", "size", "member"]).astype({"page_id": "Int64"})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = filesystem(folder)
        written, stream = [], None
        for batch in batches:
            for page_id, url, digest, size, data, first in zip(*(batch[c].astype(object) for c in ("page_id", "url", "digest", "size", "member", "first"))):
                page_id = None if pd.isna(page_id) else int(page_id)
                if not pd.isna(first) and page_id != first:
                    data = revisit(page_id, url, digest, int(size), int(first))
                if stream is None:
                    system.create_dir(top, recursive=True)
                    path = f"{top}/{uuid.uuid4().hex}.warc.gz"
                    stream = system.open_output_stream(path, compression=None)
                    written.append([f"{folder.rstrip('/')}/{path.rpartition('/')[2]}", 0, 0])
                stream.write(data)
                written[-1][1] += 1
                written[-1][2] += len(data)
                if written[-1][2] >= ARCHIVE_BYTES:
                    stream.close()
                    stream = None
        if stream is not None:
            stream.close()
        yield pd.DataFrame(written, columns=["path", "records", "bytes"])

    members = rows.mapInPandas(compress, "page_id long, url string, digest string, size long, member binary")
    return members.join(shared, "digest", "left").mapInPandas(write, "path string, records long, bytes long")


def members(stream) -> Iterator[bytearray]:
    """The inflated bytes of each gzip member, one at a time, from blocks of READ_BYTES."""
    block = b""
    while True:
        block = block or stream.read(READ_BYTES)
        if not block:
            return
        inflate, data = zlib.decompressobj(31), bytearray()
        while not inflate.eof:
            data += inflate.decompress(block)
            block = inflate.unused_data if inflate.eof else stream.read(READ_BYTES)
            if not inflate.eof and not block:
                raise EOFError("the archive ends within a record")
        yield data


def parse(data: bytearray) -> tuple[dict[str, str], memoryview]:
    """Header fields (lower-case names) and block of a record, framed by its Content-Length."""
    end = data.find(b"\r\n\r\n")
    lines = bytes(data[:end]).decode("utf-8").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size, start = int(fields["content-length"]), end + 4
    if data[start + size :] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the record")
    return fields, memoryview(data)[start : start + size]


def _page(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(URN)
    return int(digits) if digits and digits != "null" else None


def record(data: bytearray) -> tuple:
    fields, block = parse(data)
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "revisit":
        return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, int(fields["payload-length"]), digest, _page(fields["warc-refers-to"]), None
    body = bytes(block)
    payload = body[body.find(b"\r\n\r\n") + 4 :]
    return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, len(payload), digest, None, hashlib.sha256(payload).hexdigest() == digest


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives in column ``path``; verified is null for revisits, which hold no payload."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                system, inner = filesystem(path)
                rows = []
                with system.open_input_stream(inner, compression=None) as stream:
                    for data in members(stream):
                        rows.append(record(data))
                        if len(rows) == 4096:
                            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64", "verified": "boolean"})
                            rows = []
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64", "verified": "boolean"})

    return archives.mapInPandas(read, RECORDS)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, and read these back, an archive a task."""
    spark = pages.sparkSession
    archives = materialize(write_archives(pages, scratch_dir(spark) + "/warc", **columns))
    count = min(max(1, archives.count()), 50_000)  # a task may read several archives, one after the other
    return read_archives(archives.select("path").repartition(count))
