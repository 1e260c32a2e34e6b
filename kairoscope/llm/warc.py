"""WARC records in ZIP packages: a writer, and a reader that needs no extraction.

A package is a ZIP file whose members are stored, not compressed: the archive
``archive/data.warc.gz`` (one gzip member for each record) and the index
``indexes/index.cdxj`` (one line for each record: key, then JSON with its place
in the archive). Sizes and places are always written in ZIP64 form. The reader
finds the end record, follows the ZIP64 locator to the central directory,
locates the two stored members, and reads single records by their byte ranges
through ``read_at(offset, length)``, so it works on a file, an object store's
range request or a buffer alike.

Defined results: a null or empty payload is a payload of 0 bytes and is
revisited like any other; of records with equal payloads every one with the
largest page_id is a response; pages without an id are never the response where
another page has one; an empty table gives no package and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which a package is closed.
PACKAGE_BYTES = 4 << 20
MIN_BYTES = 0

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MAX32, MAX16 = 0xFFFFFFFF, 0xFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- ZIP


def zip_stored(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP64 file of stored members."""
    out, central = io.BytesIO(), []
    for name, data in members:
        at, crc, raw = out.tell(), zlib.crc32(data), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out.write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 33, crc, MAX32, MAX32, len(raw), len(extra)))
        out.write(raw + extra + data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        head = struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 33, crc, MAX32, MAX32, len(raw), len(extra), 0, 0, 0, 0, MAX32)
        central.append(head + raw + extra)
    start = out.tell()
    out.write(b"".join(central))
    size, end64 = out.tell() - start, out.tell()
    n = len(central)
    out.write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
    out.write(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
    out.write(struct.pack("<IHHHHIIH", END, 0, 0, min(n, MAX16), min(n, MAX16), MAX32, MAX32, 0))
    return out.getvalue()


class ZipPackage:
    """Stored members of a ZIP file, read by range."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        tail_at = max(0, size - 65_557)
        tail = read_at(tail_at, size - tail_at)
        at = tail.rfind(struct.pack("<I", END))
        if at < 0:
            raise ValueError("not a ZIP file: no end record")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        locator = at - 20
        if locator >= 0 and struct.unpack_from("<I", tail, locator)[0] == LOCATOR64:
            where = struct.unpack_from("<Q", tail, locator + 8)[0]
            record = read_at(where, 56)
            if struct.unpack_from("<I", record)[0] != END64:
                raise ValueError("the ZIP64 locator leads nowhere")
            n, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members = self._directory(read_at(start, length), n)

    @staticmethod
    def _directory(raw: bytes, n: int) -> dict[str, tuple[int, int, int, int]]:
        """name -> method, size, place of the local header, crc."""
        found, at = {}, 0
        for _ in range(n):
            if struct.unpack_from("<I", raw, at)[0] != CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            crc, packed, size, n_name, n_extra, n_note = struct.unpack_from("<IIIHHH", raw, at + 16)
            local = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while k + 4 <= len(extra):
                kind, width = struct.unpack_from("<HH", extra, k)
                if kind == 1:  # the fields that do not fit, in this order
                    values = iter(struct.unpack_from(f"<{width // 8}Q", extra, k + 4))
                    size = next(values) if size == MAX32 else size
                    packed = next(values) if packed == MAX32 else packed
                    local = next(values) if local == MAX32 else local
                k += 4 + width
            found[name] = (method, packed if method == 0 else size, local, crc)
            at += 46 + n_name + n_extra + n_note
        return found

    def place(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member start, and how many they are."""
        method, size, local, _ = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        n_name, n_extra = struct.unpack_from("<HH", self.read_at(local, 30), 26)
        return local + 30 + n_name + n_extra, size

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        at, size = self.place(name)
        return self.read_at(at + start, size - start if length is None else min(length, size - start))


# ---------------------------------------------------------------- WARC


def _line(text: str) -> str:
    """A header value: control characters as percent codes."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in text)


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """One gzipped record and the bare digest of its payload."""
    sha = digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    lines += ["WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 3, mtime=0), sha


def parse_record(member: bytes) -> dict:
    """Headers of a record, its HTTP headers and its payload."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields_http = dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])
    return {"warc": fields, "http": fields_http, "payload": payload}


def _page(urn: str | None) -> int | None:
    text = (urn or "<urn:page:None>")[len("<urn:page:") : -1]
    return None if text == "None" else int(text)


def _build(entries: list[tuple[int | None, str, bytes]]) -> bytes:
    archive, index, at = [], [], 0
    for page, sha, member in entries:
        place = json.dumps({"page": page, "offset": at, "length": len(member), "digest": sha})
        index.append(f"{'' if page is None else page:>20} {place}\n")
        archive.append(member)
        at += len(member)
    return zip_stored([(ARCHIVE, b"".join(archive)), (INDEX, "".join(sorted(index)).encode())])


def write_packages(records: DataFrame) -> DataFrame:
    """Columns page_id, url, html, refers_to become rows of package (binary)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries, size = [], 0
        for batch in batches:
            columns = (batch[c].astype(object) for c in ("page_id", "url", "html", "refers_to"))
            for page, url, html, refers in zip(*columns, strict=True):
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
                member, sha = warc_record(page, url, payload, refers)
                entries.append((page, sha, member))
                size += len(member)
                if size >= PACKAGE_BYTES:
                    yield pd.DataFrame({"package": [_build(entries)]})
                    entries, size = [], 0
        if entries:
            yield pd.DataFrame({"package": [_build(entries)]})

    return records.select("page_id", "url", "html", "refers_to").mapInPandas(pack, "package binary")


def read_packages(packages: DataFrame) -> DataFrame:
    """One row for each record that the indexes list, read from its byte range."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["package"]:
                view = memoryview(raw)
                package = ZipPackage(lambda at, n, view=view: bytes(view[at : at + n]), len(view))
                rows = []
                for line in package.read(INDEX).decode().splitlines():
                    place = json.loads(line[20:])
                    record = parse_record(package.read(ARCHIVE, place["offset"], place["length"]))
                    warc = record["warc"]
                    sha = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if warc["WARC-Type"] == "response" and digest(record["payload"]) != sha:
                        raise ValueError(f"the payload of page {place['page']} does not match its digest")
                    refers = warc.get("WARC-Refers-To")
                    rows.append((
                        _page(warc["WARC-Record-ID"]), int(record["http"]["Content-Length"]), sha,
                        warc["WARC-Type"], _page(refers), warc.get("WARC-Target-URI"),
                    ))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    return packages.mapInPandas(
        unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    )


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) plus refers_to: null for a response.

    The narrow table of ids and digests is grouped first; only digests that
    more than one id has are joined, and the wide rows move by page and digest,
    so a payload that many pages share stays spread over all tasks.
    """
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("w_sha", F.sha1(F.col("html").cast("binary")))
    thin = pages.where(F.octet_length("html") >= min_bytes).select("page_id", "w_sha")
    shared = thin.groupBy("w_sha").agg(F.max("page_id").alias("w_first"), F.count(F.lit(1)).alias("w_n")).where("w_n > 1 and w_first is not null")
    shared = materialize(shared.select("w_sha", "w_first"), "warc-shared")
    later = (
        thin.join(shared, "w_sha").where("page_id is null or page_id <> w_first").distinct()
        .select(F.col("page_id").alias("l_page"), F.col("w_sha").alias("l_sha"), "w_first")
    )
    return pages.join(later, F.col("page_id").eqNullSafe(F.col("l_page")) & (F.col("w_sha") == F.col("l_sha")), "left").select(
        "page_id", "url", "html", F.col("w_first").alias("refers_to")
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = materialize(write_packages(with_revisits(read_table(spark, sf_dir, "pages"))), "warc-packages")
    return read_packages(packages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
