"""WARC archives and the monolithic-gzip normaliser (operator 3).

``write_archives``   writes WARC/1.1 records as whole-file gzip streams, as
                     careless crawlers do; payloads of at least ``MIN_REVISIT``
                     bytes that occur again become ``revisit`` records.
``normalise``        inflates each such stream once, front to back, and writes
                     every record as a gzip member of its own, with a sidecar
                     index (offset and length of each member).
``read_archives``    opens members through the index and returns their records.

Files lie in a shared folder.  A task writes files under fresh names and
returns them; only files in the staged list of a finished job are read, so
retried or speculative tasks leave no trace in the result.  Records pass
through in blocks; memory does not grow with a record in the normaliser.

Null html counts as an empty payload, a null url as an empty target.  Rows
with one page id and one payload are all ``response`` if they are the first;
a null page id never is the first of a group that has another.  An empty table
writes no records.  Other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import uuid
import zlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrove.llm.common import open_store, shared_path, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_REVISIT = 100
ROLL_BYTES = 64 << 20
LEVEL = 4
BLOCK = 1 << 18
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def dedupe(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``; refers_to is null for responses."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = p.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 and first is not null").select("digest", "first")
    return p.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    http = HTTP.format(len(payload)).encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def _write(folder: str, roll: int):
    def run(batches):
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        out = gz = name = None
        size = n = 0

        def close():
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

        for b in batches:
            for page_id, url, payload, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, gz = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = record(page_id, url, payload, digest, refers)
                out.write(gz.compress(raw))
                size += len(raw)
                n += 1
                if size >= roll:
                    yield close()
                    out = None
        if out is not None:
            yield close()
    return run


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, roll: int = ROLL_BYTES) -> DataFrame:
    """Whole-file gzip archives of all rows in ``folder``; the list ``(file, records)``."""
    return stage(dedupe(pages, min_revisit).mapInArrow(_write(folder, roll), "file string, records long"), "warc-files")


class Inflated:
    """The bytes of a gzip file, whatever its members, read once in blocks."""

    def __init__(self, source) -> None:
        self.source, self.gz, self.have, self.raw, self.clean = source, zlib.decompressobj(31), bytearray(), b"", True

    def fill(self) -> bool:
        raw = self.raw or self.source.read(BLOCK)
        self.raw = b""
        if self.clean:
            raw = raw.lstrip(b"\0") if raw else raw  # padding between members
        if not raw:
            if not self.clean:
                raise EOFError("the gzip stream ends within a member")
            return False
        self.have += self.gz.decompress(raw)
        self.clean = self.gz.eof
        if self.gz.eof:
            self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
        return True

    def head(self) -> bytes:
        """The next record's header with the empty line that ends it; nothing at the end of the file."""
        mark, seen = b"\r\n\r\n", 0
        while True:
            while self.have[:2] == b"\r\n":  # the end of the record before
                del self.have[:2]
                seen = 0
            if len(self.have) > 1 and (at := self.have.find(mark, max(0, seen - 3))) >= 0:
                break
            seen = len(self.have)
            if not self.fill():
                if self.have.strip():
                    raise EOFError("the archive ends within a record header")
                return b""
        out = bytes(self.have[:at + 4])
        del self.have[:at + 4]
        return out

    def blocks(self, n: int):
        while n:
            if not self.have and not self.fill():
                raise EOFError("the archive ends within a record")
            out = bytes(self.have[:min(n, BLOCK)])
            del self.have[:len(out)]
            n -= len(out)
            if out:
                yield out


def fields(head: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _normalise(source: str, target: str):
    def run(batches):
        fs, root = open_store(source)
        fs2, root2 = open_store(target)
        fs2.create_dir(root2, recursive=True)
        for b in batches:
            for name in b.column("file").to_pylist():
                new = f"{uuid.uuid4().hex}.warc.gz"
                at, index = 0, []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as src, fs2.open_output_stream(f"{root2}/{new}", compression=None) as out:
                    data = Inflated(src)
                    while head := data.head():
                        f = fields(head)
                        gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        start = at
                        at += out.write(gz.compress(head)) or 0
                        for block in data.blocks(int(f["content-length"])):
                            at += out.write(gz.compress(block)) or 0
                        at += out.write(gz.compress(b"\r\n\r\n") + gz.flush()) or 0
                        at = out.tell()
                        index.append({"offset": start, "length": at - start, "type": f.get("warc-type", ""), "id": f.get("warc-record-id", ""), "uri": f.get("warc-target-uri", "")})
                with fs2.open_output_stream(f"{root2}/{new}.idx", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([len(index)], pa.int64())], ["file", "records"])
    return run


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Record-wise archives and their ``.idx`` sidecars in ``target`` for the listed files of ``source``."""
    n = max(1, files.count())
    return stage(files.repartition(n).mapInArrow(_normalise(source, target), "file string, records long"), "warc-normal")


def _index(folder: str):
    def run(batches):
        fs, root = open_store(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                with fs.open_input_stream(f"{root}/{name}.idx", compression=None) as src:
                    rows = [json.loads(x) for x in src.read().decode().split("\n") if x]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r["offset"] for r in rows], pa.int64()),
                                                  pa.array([r["length"] for r in rows], pa.int64())], ["file", "offset", "length"])
    return run


RECORD = "page_id long, record_type string, refers_to long, uri string, payload_bytes long, payload_digest string, payload binary"


def _number(urn: str):
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m else None


def read_member(raw: bytes) -> tuple:
    """A member's record as a row of ``RECORD``; the payload's length and digest are of its full payload."""
    data = zlib.decompress(raw, 31)
    head, rest = data.split(b"\r\n\r\n", 1)
    f = fields(head)
    http, payload = rest[:int(f["content-length"])].split(b"\r\n\r\n", 1)
    if f["warc-type"] == "revisit":
        return (_number(f["warc-record-id"]), "revisit", _number(f["warc-refers-to"]), f["warc-target-uri"], int(fields(http)["content-length"]),
                f["warc-payload-digest"].removeprefix("sha256:"), None)
    return _number(f["warc-record-id"]), "response", None, f["warc-target-uri"], len(payload), hashlib.sha256(payload).hexdigest(), payload


def _read(folder: str, payload: bool):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        fs, root = open_store(folder)
        name, src = None, None
        for b in batches:
            rows, size = [], 0
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if src is not None:
                        src.close()
                    name, src = file, fs.open_input_file(f"{root}/{file}")
                row = read_member(src.read_at(length, offset))
                rows.append(row if payload else (*row[:6], None))
                size += len(row[6] or b"") * payload
                if len(rows) >= 5000 or size >= 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if src is not None:
            src.close()
    return run


def read_archives(files: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of normalised archives, each opened by its place in the index."""
    places = files.select("file").mapInArrow(_index(folder), "file string, offset long, length long")
    return places.mapInArrow(_read(folder, payload), RECORD)


def archive(pages: DataFrame, payload: bool = True, **kw) -> DataFrame:
    """Writes, normalises and reads back the archives of all rows of ``pages``."""
    spark = pages.sparkSession
    raw, target = shared_path(spark, "warc-raw"), shared_path(spark, "warc")
    return read_archives(normalise(write_archives(pages, raw, **kw), raw, target), target, payload)
