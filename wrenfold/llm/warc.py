"""WARC archives: a writer through Spark's own committer and a splittable reader.

Writer: Python makes each record a gzip member (records over 8 MB: several, in a row). Spark's text writer puts them
into files, so any store and lost or repeated tasks are its business. It ends each row with one byte; a member's last
byte is the top byte of its length, zero under 16 MB, so that byte is left to the writer, as its line separator.

Reader: tasks get byte ranges of the files, scan them for gzip's magic bytes, take those for members whose decoded
start is a WARC header, and own the records that start inside their range, reading past its end as far as need be.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Smaller payloads are all written whole.
LEAST_BYTES = 1000
MEMBER_BYTES = 8 << 20
#: Bytes of a range, and reading tasks at most; beyond, a task takes several ranges in turn.
RANGE_BYTES, MOST_TASKS = 32 << 20, 1 << 15
_READ = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_URN = "urn:page:"


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(rid, digest, refers_to): pages whose payload, of at least LEAST_BYTES, a page with a larger id has too.

    Payloads are compared by SHA-256 and length; only these are shuffled. Minima and maxima are aggregated before the
    join back, so a payload that very many pages share is no hot task but a skewed join, which is split.
    """
    body = F.coalesce(F.col(payload_col), F.lit(""))
    keys = pages.select(F.col(id_col).alias("rid"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n")).where(f"n >= {LEAST_BYTES}")
    last = keys.groupBy("digest", "n").agg(F.max("rid").alias("refers_to"), F.min("rid").alias("lo")).where("lo < refers_to").drop("lo")
    return keys.join(last, ["digest", "n"]).where("rid < refers_to").select("rid", "digest", "refers_to").distinct()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, body: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 response or revisit record, gzip-compressed; the HTTP header keeps the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + (body if refers_to is None else b"")
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return b"".join(_member(data[a : a + MEMBER_BYTES]) for a in range(0, len(data), MEMBER_BYTES))


def write(scratch: Scratch, pages: DataFrame, name: str = "warc", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Writes a record for every page; the archives' folder. Null payloads are empty; null ids are in no revisit."""
    known = scratch.put(revisits(pages, id_col, payload_col), f"{name}-revisits")
    body = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("rid"), F.col(url_col).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    rows = rows.join(known, ["rid", "digest"], "left").select("rid", "url", "body", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one record at a time: payloads may be long
                rid, url, body, to = (c[i] for c in b.columns)
                yield pa.RecordBatch.from_arrays([pa.array([record(rid.as_py(), url.as_py(), body.as_py().encode(), to.as_py())[:-1]], pa.binary())], ["r"])

    with scratch.cleaning():
        rows.mapInArrow(run, "r binary").select(F.col("r").cast("string").alias("value")).write.option("lineSep", "\0").text(scratch.path(name))
    scratch.drop(f"{name}-revisits")
    return scratch.path(name)


# --- reading ----------------------------------------------------------------------------------------------------------


def open_at(uri: str) -> BinaryIO:
    """A seekable file of any store that pyarrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return store.open_input_file(path)


def _decoded(file: BinaryIO, at: int, most: int | None = None) -> tuple[bytes, int] | None:
    """What the gzip member at `at` holds (its first `most` bytes) and where it ends; None if it is none."""
    file.seek(at)
    z, out, end = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            part = file.read(_READ if most is None else 4096)
            if not part:
                return None
            out.append(z.decompress(part))
            end += len(part) - len(z.unused_data)
            if most is not None and sum(map(len, out)) >= most:
                break
    except zlib.error:
        return None
    return b"".join(out), end


def _record_at(file: BinaryIO, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record that starts at `at`; None if none does."""
    start = _decoded(file, at, 16)
    if start is None or not start[0].startswith(b"WARC/1."):
        return None
    data, end = _decoded(file, at) or (b"", at)
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep:
        return None
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    length, parts, got = int(fields["Content-Length"]), [rest], len(rest)
    while got < length + 4:  # a long record goes on in further members
        more = _decoded(file, end)
        if more is None:
            raise ValueError(f"a record is cut off at byte {end}")
        parts.append(more[0])
        got, end = got + len(more[0]), more[1]
    return fields, b"".join(parts)[:length], end


def records_in(file: BinaryIO, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start from `start` on and before `stop`."""
    at = start
    while at < stop:
        found = _record_at(file, at)
        if found:
            yield found[0], found[1]
            at = found[2]
            continue
        file.seek(at + 1)  # no record here: look for the next magic bytes, some of which may lie past `stop`
        part = file.read(min(_READ, stop - at - 1) + len(_MAGIC) - 1)
        k = part.find(_MAGIC)
        at = at + 1 + k if k >= 0 else at + 1 + max(1, len(part) - len(_MAGIC) + 1)


def row_of(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to; a response's payload is checked."""
    ident = lambda s: None if s is None or s[1:-1] == f"{_URN}null" else int(s[1:-1].removeprefix(_URN))
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and (len(body) != size or hashlib.sha1(body).digest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its digest")
    return ident(fields["WARC-Record-ID"]), size, digest.hex(), fields["WARC-Type"], ident(fields.get("WARC-Refers-To"))


def ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, stop): the byte ranges of a folder's archives, a partition each (of up to MOST_TASKS).

    The number of partitions is given, since rows as small as these would be put together by adaptive execution.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")
    n = files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 1
    step = F.lit(range_bytes).cast("long")
    # from one partition, so that dealing in turn is even; a row a file
    each = files.repartition(1).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"))
    return each.select("path", "start", F.least(F.col("start") + step, F.col("length")).alias("stop")).repartition(int(min(n, MOST_TASKS)))


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row for every record of the folder's archives. An archive of any length is read by many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for r in b.to_pylist():
                rows = []
                with open_at(r["path"]) as file:
                    for fields, block in records_in(file, r["start"], r["stop"]):
                        rows.append(row_of(fields, block))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names)

    return ranges(spark, folder, range_bytes).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every page, from archives written and read."""
    folder = write(Scratch(spark, "op7"), table(spark, sf_dir, "pages"))
    return read(spark, folder)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM r
"""
