"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Writing: each partition writes one archive file into the shared folder under a name of its own attempt; the rows that
come back name the files of the attempts that counted, so a lost or repeated task leaves no record twice.

Reading: archives are cut into byte ranges.  A task looks for the gzip magic from the start of its range, validates a
candidate by inflating its first bytes and decoding the WARC version and headers, and owns every record whose member
starts inside its range, reading over the range's end where a member does.  Members are inflated in a stream.

Paths are opened through Arrow's file systems (local, hdfs, s3, gs), so archives can lie in any shared store.

Defined cases: a null html is an empty payload; a null page_id is written and read as null; of equal payloads of at least
``least`` bytes all rows with the largest page_id are responses (repeated rows keep theirs), nulls being the smallest; an
empty table gives no archives and no rows; columns other than page_id, url and html are not read.

Archives of other writers are read as well: header names in any case, record ids of any form (page_id is null unless it is
one of ours), records of any type (warcinfo, request and metadata too), payloads behind the header of an HTTP message, and revisits
without a length (payload_bytes is null) or digest (null).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import shared_folder, stored

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
OUR_ID = re.compile(r"<urn:page:(-?\d+)>")
LEAST = 1000
SPLIT_BYTES = 8_000_000
#: Tasks that read at most; each then takes several ranges.
MOST_READERS = 20_000
HEAD = 1 << 16


def payload_roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload (binary) and refers_to: the response's page_id for revisits, else null; is_revisit."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    many = rows.filter(F.octet_length("payload") >= least)
    repeated = many.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).filter("n > 1").select("digest", "top")
    out = rows.join(repeated, "digest", "left").withColumn("is_revisit", F.coalesce((F.octet_length("payload") >= least) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.lit(False)))
    return out.withColumn("refers_to", F.when(F.col("is_revisit"), F.col("top"))).drop("top")


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page_id is None else str(page_id).encode())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, is_revisit: bool, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit has the digest and length of its payload in place of the payload."""
    kind = b"revisit" if is_revisit else b"response"
    fields = [b"WARC-Type: " + kind, b"WARC-Record-ID: " + _urn(page_id), b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: text/html"]
    if url is not None:
        fields.append(b"WARC-Target-URI: " + "".join(url.split()).encode("utf-8", "surrogatepass"))
    if is_revisit:
        fields += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _urn(refers_to), b"X-Payload-Length: %d" % len(payload)]
    body = b"" if is_revisit else payload
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n".join([*fields, b"Content-Length: %d" % len(body)]) + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write all pages; a stored row (path, size, records) per archive that counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        size = records = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    system, base = pyarrow.fs.FileSystem.from_uri(folder)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    system.create_dir(base, recursive=True)
                    out, path = system.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}"
                size += out.write(record(*row)) or 0
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "records": [records]})

    rows = payload_roles(pages, least).select("page_id", "url", "payload", "digest", "is_revisit", "refers_to")
    return stored(rows.mapInArrow(run, "path string, size long, records long"))


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, record_id string"


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """Records of archives (path, size) by byte ranges, each by the range in which it starts."""
    ranges = (files.filter("size > 0").withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))))
              .select("path", "begin", F.least(F.col("begin") + split_bytes, F.col("size")).alias("end")))
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                system, plain = pyarrow.fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_file(plain) as file:
                    for fields, payload in records_of(file, begin, end):
                        rows.append(_row(fields, payload, with_payload))
                        held += len(payload) if with_payload else 100
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in READ.split(", ")])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    # A number of its own: by their bytes the ranges themselves would all go to one task.
    readers = max(1, min(ranges.count(), MOST_READERS))
    return ranges.repartition(readers, F.xxhash64("path", "begin")).mapInArrow(run, READ)


def records_of(file, begin: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of the records whose members start in [begin, end)."""
    reader = _Bytes(file, begin)
    at = begin
    while at < end:
        at = reader.find(MAGIC, at, end)
        if at < 0:
            return
        member = _member(reader, at)
        if member is None:
            at += 1
            continue
        fields, payload, at = member
        yield fields, payload


class _Bytes:
    """A window over a file that grows forwards and forgets what lies behind."""

    def __init__(self, file, begin: int) -> None:
        self.file, self.base, self.data = file, begin, b""

    def take(self, at: int, size: int) -> bytes:
        """Bytes [at, at + size), fewer at the end of the file."""
        if at < self.base or at > self.base + len(self.data):
            self.base, self.data = at, b""
        if at + size > self.base + len(self.data):
            kept = self.data[at - self.base:]
            self.file.seek(at + len(kept))
            self.base, self.data = at, kept + self.file.read(max(size, 1 << 20) - len(kept))
        return self.data[at - self.base:at - self.base + size]

    def find(self, what: bytes, at: int, end: int) -> int:
        """First place of ``what`` that begins in [at, end), else -1."""
        while at < end:
            chunk = self.take(at, min(1 << 20, end - at) + len(what) - 1)
            hit = chunk.find(what)
            if hit >= 0:
                return at + hit
            if len(chunk) < len(what):
                return -1
            at += len(chunk) - len(what) + 1
        return -1


def _member(reader: _Bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, payload and the end of the member at ``at``; None if it is no member or no record."""
    inflate, parts, place = zlib.decompressobj(31), [], at
    checked = False
    try:
        while not inflate.eof:
            chunk = reader.take(place, HEAD)
            if not chunk:
                return None
            parts.append(inflate.decompress(chunk))
            place += len(chunk)
            if not checked and (inflate.eof or sum(map(len, parts)) >= len(VERSION)):
                if not b"".join(parts).startswith(b"WARC/"):
                    return None
                checked = True
    except zlib.error:
        return None
    data = b"".join(parts)
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = [line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]]
    fields = {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, rest[:int(fields["content-length"])], place - len(inflate.unused_data)


def _row(fields: dict[str, str], payload: bytes, with_payload: bool) -> tuple:
    kind, size = fields["warc-type"], fields.get("x-payload-length", "")
    if fields.get("content-type", "").lower().startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    if kind == "revisit":
        length, digest = int(size) if size.isdigit() else None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    else:
        length, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return (_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, length, digest, _page(fields.get("warc-refers-to")), payload if with_payload else None,
            fields.get("warc-record-id"))


def _page(urn: str | None) -> int | None:
    """The page_id in a record id of ours."""
    ours = OUR_ID.fullmatch(urn or "")
    return int(ours[1]) if ours else None


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared one."""
    folder = shared_folder(spark).rstrip("/")
    return f"{folder if ':' in folder else 'file://' + folder}/warc-{uuid.uuid4().hex}"
