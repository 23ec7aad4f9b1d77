"""Web archives packed in ZIP files: writing, and reading by range without extraction.

A package is a ZIP file whose members are stored, not deflated: `archive/data.warc.gz`, one gzip member per WARC record,
and `indexes/index.cdxj`, one JSON line per record with its offset and length in that member. A reader fetches the end of
the file, the central directory (ZIP64 if there is one), the local headers of both members and the index, and then only
the byte ranges of records.

Files are opened by URI through Arrow's file systems, so packages may lie on any store that all workers share.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlelake.llm.shared import keep
from candlelake.workspace import work_dir

Batches = Iterator[pa.RecordBatch]

# Signatures and sizes of the ZIP format, names of the members.
END, END64, END64_LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, MAX_COMMENT = 22, 20, 65_535
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Payloads below this size are stored again each time.
LEAST_REVISIT = 100
#: Bytes of records after which a task begins another package, and most bytes fetched at once.
PACKAGE_BYTES, FETCH_BYTES = 256_000_000, 4_000_000
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


# --- reading a ZIP file by ranges --------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    offset: int
    size: int
    method: int


def _extra64(extra: bytes, values: list[int], limits: list[int]) -> list[int]:
    """Replace the values that are at their limit by those of the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(wide) if v == limit else v for v, limit in zip(values, limits, strict=True)]
        at += 4 + size
    return values


def directory(read: Callable[[int, int], bytes], size: int) -> dict[str, Member]:
    """Name, place and size of every member, from the central directory alone; `offset` is that of the local header."""
    tail_at = max(0, size - END_SIZE - MAX_COMMENT - LOCATOR_SIZE)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = tail[end - LOCATOR_SIZE : end]
        if not locator.startswith(END64_LOCATOR):
            raise ValueError("ZIP64 locator is missing")
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if not record.startswith(END64):
            raise ValueError("ZIP64 end of central directory is missing")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    body, at, out = read(start, length), 0, {}
    for _ in range(count):
        if body[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", body, at + 10)
        packed, plain, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", body, at + 20)
        offset, = struct.unpack_from("<I", body, at + 42)
        name = body[at + 46 : at + 46 + name_size].decode("utf-8")
        extra = body[at + 46 + name_size : at + 46 + name_size + extra_size]
        plain, packed, offset = _extra64(extra, [plain, packed, offset], [0xFFFFFFFF] * 3)
        out[name] = Member(offset, packed, method)
        at += 46 + name_size + extra_size + comment_size
    return out


def data_start(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where the bytes of a stored member begin, behind its local header."""
    head = read(member.offset, 30)
    if not head.startswith(LOCAL) or member.method != 0:
        raise ValueError("the member is not stored, or its local header is broken")
    name_size, extra_size = struct.unpack_from("<HH", head, 26)
    return member.offset + 30 + name_size + extra_size


class Package:
    """Records of one package, fetched by range."""

    def __init__(self, path: str) -> None:
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        self.members = directory(self.read, self.file.size())
        self.start = data_start(self.read, self.members[DATA])

    def read(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def index(self) -> list[tuple[int, int]]:
        member = self.members[INDEX]
        lines = self.read(data_start(self.read, member), member.size).splitlines()
        return [(x["offset"], x["length"]) for x in map(json.loads, lines)]

    def records(self, entries: list[tuple[int, int]]) -> Iterator[bytes]:
        """Unpacked records; neighbours share a fetch of up to FETCH_BYTES."""
        group: list[tuple[int, int]] = []
        for entry in [*entries, None]:
            if group and (entry is None or entry[0] != sum(group[-1]) or sum(entry) - group[0][0] > FETCH_BYTES):
                block = self.read(self.start + group[0][0], sum(group[-1]) - group[0][0])
                for offset, length in group:
                    yield zlib.decompress(block[offset - group[0][0] : offset - group[0][0] + length], 31)
                group = []
            if entry is not None:
                group.append(entry)


# --- records -----------------------------------------------------------------------------------------


def _name(page_id: int | None) -> str:
    return "<urn:page:" + ("none" if page_id is None else str(page_id)) + ">"


def _number(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def build_record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """One WARC record; a revisit names the response that holds its payload and has no body of its own."""
    body = HTTP % len(payload) + payload if kind == "response" else b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _name(page_id))]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(size))]
    if kind == "revisit":
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The fields of RECORD; the digest and the size of a stored payload are computed again and compared."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(fields["Content-Length"])]
    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"])
    payload = None
    if kind == "response":
        payload = body.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": _number(refers) if refers else None, "payload_bytes": size, "payload_digest": digest, "payload": payload}


# --- Spark jobs ---------------------------------------------------------------------------------------


def _write(base: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        system, folder = fs.FileSystem.from_uri(base)
        system.create_dir(folder, recursive=True)
        rows = ((r, b) for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "kind", "refers_to", "digest", "size", "payload")), strict=True))
        rows = iter(r for r, _ in rows)
        row = next(rows, None)
        while row is not None:
            # The name is new in each attempt; only packages of attempts that ended well are in the manifest.
            name = f"{uuid.uuid4().hex}.wacz"
            index, at = [], 0
            with system.open_output_stream(f"{folder}/{name}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                with package.open(DATA, "w", force_zip64=True) as data:
                    while row is not None and at < PACKAGE_BYTES:
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        record = packer.compress(build_record(*row)) + packer.flush()
                        data.write(record)
                        index.append(json.dumps({"page_id": row[0], "offset": at, "length": len(record)}))
                        at += len(record)
                        row = next(rows, None)
                with package.open(INDEX, "w", force_zip64=True) as lines:
                    lines.write("\n".join(index).encode())
            yield pa.RecordBatch.from_pylist([{"package": f"{base}/{name}", "records": len(index)}])

    return run


def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per row and return the manifest: package (URI), records.

    Of rows with equal payloads of at least `least` bytes, those with the smallest id are responses (null ids count only
    if there are no others; rows that share the smallest id are all responses) and the others revisit it. Smaller
    payloads are always responses. Null payloads are empty. Ids are integers; other columns are not read. An empty table
    gives an empty manifest. Eager: packages and manifest are in the shared folder when this returns.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    first = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    typed = rows.join(first, "digest", "left").select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"), "digest", "size",
        F.when(~revisit, F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
    )
    return keep(typed.mapInArrow(_write(work_dir(spark)), "package string, records long"))


def read_packages(packages: DataFrame) -> DataFrame:
    """All records of the packages named in column `package`: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (null for revisits). A broken package or record is an error."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                package, rows, size = Package(path), [], 0
                for record in package.records(package.index()):
                    rows.append(parse_record(record))
                    size += len(record)
                    if size >= FETCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    spread = packages.select("package").repartition(_tasks(packages.sparkSession))
    return spread.mapInArrow(run, RECORD)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
