"""WARC records in ZIP packages, and a reader that takes single records out by range.

Writing: every task writes its rows as records (gzip by record) into packages of a bounded size in
the shared folder: a stored member with the records and a stored member with an index of page,
offset and length. Names are unique to the attempt, so a task that runs again leaves its first
package aside. Reading: the end of the file leads to the central directory, by the ZIP64 record
where there is one; the directory to the members; the index to the records, which are read by range.
Nothing is extracted.

Payloads that repeat are revisit records without a body. Null html is an empty payload; payloads
under 100 bytes are never revisits. Rows with a null page_id are responses. Rows that repeat an id
and a payload are all responses if that id is the smallest. Line breaks in a URL become %0A and %0D.
Any pages table gives a row per row; an empty one none.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, stored, table

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Bytes of records after which a task starts another package.
PACKAGE_BYTES = 64 << 20
#: Payloads below this are always written out.
LEAST_REVISIT = 100


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of refers_to whose HTTP header alone tells the payload's size."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}"]
    lines += [f"WARC-Target-URI: {url.replace(chr(10), '%0A').replace(chr(13), '%0D')}"] if url is not None else []
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed_record(raw: bytes) -> dict:
    """Headers, type, page, the page it refers to, the HTTP header's size and the payload (null for revisits)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    kind = headers["WARC-Type"]
    return {
        "headers": headers, "record_type": kind, "page_id": page(headers["WARC-Record-ID"]), "refers_to": page(headers.get("WARC-Refers-To")),
        "payload_bytes": size, "payload": None if kind == "revisit" else payload,
    }


class PackageWriter:
    """A ZIP file with the two stored members; zip64 forces the large-file structures."""

    def __init__(self, out, zip64: bool = False) -> None:
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.zip64, self.offset, self.lines = zip64, 0, []
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)

    def add(self, page_id: int | None, raw: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = packer.compress(raw) + packer.flush()
        self.member.write(data)
        self.lines.append(json.dumps({"page": page_id, "offset": self.offset, "length": len(data)}))
        self.offset += len(data)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()


def members(read_at, size: int) -> dict[str, tuple[int, int]]:
    """Name to (place of the data, length) of the stored members of a ZIP file; read_at(place, length) gives bytes."""
    tail_at = max(0, size - (22 + 65535 + 20))
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        place = struct.unpack("<Q", tail[end - 12 : end - 4])[0]
        large = read_at(place, 56)
        if large[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory")
        count, length, start = struct.unpack("<QQQ", large[32:56])
    directory, at, out = read_at(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        method, = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, plain, n, m, k = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        local, = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + n].decode()
        extra, i = directory[at + 46 + n : at + 46 + n + m], 0
        while i + 4 <= len(extra):
            kind, size_of = struct.unpack("<HH", extra[i : i + 4])
            if kind == 1:  # 64-bit values, only for fields that are all ones
                values = iter(struct.unpack(f"<{size_of // 8}Q", extra[i + 4 : i + 4 + size_of // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            i += 4 + size_of
        if method == 0:
            names, more = struct.unpack("<HH", read_at(local + 26, 4))
            out[name] = (local + 30 + names + more, packed)
        at += 46 + n + m + k
    return out


def records_of(read_at, size: int) -> Iterator[dict]:
    """The parsed records of a package, by its index."""
    found = members(read_at, size)
    base, _ = found[RECORDS]
    for line in read_at(*found[INDEX]).decode().split("\n"):
        if line:
            own = json.loads(line)
            yield parsed_record(zlib.decompress(read_at(base + own["offset"], own["length"]), 31))


def refers(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload a smaller page has. Pages: page_id, url, payload, digest."""
    keys = pages.filter(F.octet_length("payload") >= least).filter("page_id is not null").select("page_id", "digest")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last").drop("last")
    # a table, so that Spark can split a digest that many pages have
    return keys.join(stored(firsts, "firsts"), "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as packages; returns their manifest: path, records, bytes."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = fresh_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    marked = rows.join(refers(rows), ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        package = stream = None
        done: list[tuple[str, int, int]] = []

        def finish() -> None:
            package.close()
            stream.close()
            done.append((name, len(package.lines), package.offset))

        for batch in batches:
            for r in batch.to_pylist():
                if package is None:
                    name = f"{base}/{uuid.uuid4().hex}.wacz"
                    stream = target.open_output_stream(name)
                    package = PackageWriter(stream)
                raw = record(r["page_id"], r["url"], r["payload"], len(r["payload"]), r["digest"], r["refers_to"])
                package.add(r["page_id"], raw)
                if package.offset >= package_bytes:
                    finish()
                    package = None
        if package is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    manifest = marked.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long, bytes long")
    return stored(manifest, "warc-manifest").withColumn("root", F.lit(folder))


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the packages: page_id, url, payload_bytes, payload_digest, record_type, refers_to; with payloads also the payload."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.to_pylist():
                source, _ = fs.FileSystem.from_uri(own["root"])
                rows = []
                with source.open_input_file(own["path"]) as f:
                    for r in records_of(lambda at, n, f=f: f.read_at(n, at), f.size()):
                        digest = r["headers"]["WARC-Payload-Digest"].removeprefix("sha256:")
                        if r["payload"] is not None and (hashlib.sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != r["payload_bytes"]):
                            raise ValueError(f"payload of page {r['page_id']} doesn't match its digest")
                        rows.append((r["page_id"], r["headers"].get("WARC-Target-URI"), r["payload_bytes"], digest, r["record_type"], r["refers_to"], r["payload"])[: len(names)])
                        if len(rows) >= 1000:
                            yield batch_of(rows, names)
                            rows = []
                yield batch_of(rows, names)

    shares = max(1, manifest.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    return manifest.repartition(shares).mapInArrow(run, schema)


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(range(len(names)), types, strict=False)], names=names)


def read_bytes(data: bytes) -> list[dict]:
    """The records of a package that is at hand as bytes."""
    f = io.BytesIO(data)
    return list(records_of(lambda at, n: (f.seek(at), f.read(n))[1], len(data)))


def op10_warc_zip(spark, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when p.page_id <> f.first then 'revisit' else 'response' end as record_type,
  case when p.page_id <> f.first then f.first end as refers_to
from p left join f on p.d = f.d and p.n >= 100
"""
