"""WARC: writing captures, reading archives, assembling transactions.

Each page becomes three records (request; response or revisit; metadata) that name one
another through WARC-Concurrent-To. Every record is a gzip member of its own and each file
begins with a warcinfo record, as the format asks. Spark's own text writer stores the bytes, with
its commit protocol and on any file system Spark can reach: a member of less than 16 MB ends in a
zero byte (the top of its length), which is the writer's line separator here, and a larger one
gets an empty member after it. Archives are read back whole, a bounded file at a time (2 GB at
most), and parsed by Content-Length. ``transactions`` joins the three kinds through their
concurrent-to identifiers, whichever side names the other, into one nested row per capture.
``read_transactions`` does the same while it reads: the records of a capture mostly lie in one file, so
each reader joins those that do, payloads in place, and only records without their partners in the file
are joined across files.

Payloads of ``min_bytes`` or more that are equal (SHA-1 and length) are stored once, with the
largest page_id; the others become revisit records of the HTTP head alone, which carry the digest
and, in WARC-Refers-To, the record that has the payload. What the format has no field for
(page_id, the page referred to) stands in the metadata record.

Defined results: null html is an empty payload, null url an empty target; a null page_id is
written as such, and holds a payload only if no page with an id does; repeated rows are
captures of their own (where they hold a payload, revisits name the page but no record, as there
are several); an empty table gives an empty result; other columns are ignored, whatever their
names; a very long page is one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

CRLF = "\r\n"
RECORDS_PER_FILE = 1000
LEVEL = 6
_LINES = re.compile(r"[\r\n]")
DATE = "2020-01-01T00:00:00Z"
#: Bytes handed to Arrow at once.
_BATCH = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 160 bits are eight groups of five hex digits, each four base32 digits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, at: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record with its end. Header values lose line breaks, as they would end the header."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {at}", f"WARC-Date: {DATE}", *(f"{k}: {_LINES.sub(' ', v)}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return CRLF.join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    return gzip.compress(record, LEVEL, mtime=0)


def _uuid(*parts) -> str:
    return uuid.UUID(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()).urn


def _http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {n}{CRLF * 2}".encode()


def _captures(per_file: int):
    """Rows to write, each the gzip members of a capture but for the last byte, a zero; the first of each file begins with a warcinfo record."""

    def capture(page, url, html, digest, holder, copies) -> list[bytes]:
        n, again = len(html), holder is not None and page != holder
        at = f"<{_uuid('response', page, digest) if page is not None and page == holder and copies == 1 else uuid.uuid4().urn}>"
        target, beside = ("WARC-Target-URI", url), ("WARC-Concurrent-To", at)
        request = f"GET {_LINES.sub(' ', url) or '/'} HTTP/1.1{CRLF * 2}".encode("utf-8", "replace")
        out = [_record("request", f"<{uuid.uuid4().urn}>", [beside, target, ("Content-Type", "application/http; msgtype=request")], request)]
        named = [target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
        if again:
            named += [("WARC-Profile", PROFILE)] + ([("WARC-Refers-To", f"<{_uuid('response', holder, digest)}>")] if copies == 1 else [])
        out.append(_record("revisit" if again else "response", at, named, _http_head(n) + (b"" if again else html)))
        fields = {"page-id": page, "payload-bytes": n, "refers-to-page": holder if again else None}
        block = "".join(f"{k}: {v}{CRLF}" for k, v in fields.items() if v is not None).encode()
        out.append(_record("metadata", f"<{uuid.uuid4().urn}>", [beside, target, ("Content-Type", "application/warc-fields")], block))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            out, held = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "holder", "copies")), strict=True):
                records = capture(*row)
                if at % per_file == 0:
                    info = f"software: tallyrank{CRLF}format: WARC File Format 1.1{CRLF}".encode()
                    records.insert(0, _record("warcinfo", f"<{uuid.uuid4().urn}>", [("Content-Type", "application/warc-fields")], info))
                data = b"".join(map(_member, records))
                data += b"" if data[-1] == 0 else _member(b"")
                out.append(data[:-1])
                held += len(data)
                at += 1
                if held > _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("n", F.octet_length("html"))
    # counted and reduced before the shuffle, so that a payload held by a third of the pages is a row per task and page
    per = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n", "page_id").agg(F.count("*").alias("c"))
    held = per.groupBy("digest", "n").agg(F.max(F.struct("page_id", "c")).alias("m"), F.sum("c").alias("all")).where(F.col("all") > 1)
    held = stored(held.select("digest", "n", F.col("m.page_id").alias("holder"), F.col("m.c").alias("copies")), "warc-holders")
    out = rows.join(held.hint("shuffle_hash"), ["digest", "n"], "left").select("page_id", "url", "html", "digest", "holder", "copies")
    members = out.mapInArrow(_captures(RECORDS_PER_FILE), "value binary").select(F.col("value").cast("string").alias("value"))  # the bytes as they are
    members.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORD = "kind string, record_id string, concurrent_to array<string>, uri string, refers_to_record string, page_id long, refers_to long, payload_digest string, payload_bytes long, intact boolean, block binary"


def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers by lower-case name, block) of each record of a WARC byte stream. Of repeated headers all values stand, a line each."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            name, value = name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()
            headers[name] = f"{headers[name]}\n{value}" if name in headers else value
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("archive ends within a record")
        yield headers, block


class _Inflate(io.RawIOBase):
    """Reads gzip members one after another without holding the whole content inflated."""

    def __init__(self, data: bytes):
        self.data, self.inflate, self.at = memoryview(data), zlib.decompressobj(31), 0
        self.left = b""

    def readable(self):
        return True

    def readinto(self, buffer):
        want = len(buffer)
        while True:
            if self.inflate.eof:
                rest = self.inflate.unused_data
                if not rest and self.at >= len(self.data):
                    return 0
                self.inflate, self.left = zlib.decompressobj(31), rest
            if not self.left and self.at < len(self.data):
                self.left = bytes(self.data[self.at : self.at + 65536])
                self.at += 65536
            out = self.inflate.decompress(self.left, want)
            self.left = self.inflate.unconsumed_tail
            if out:
                buffer[: len(out)] = out
                return len(out)
            if not self.left and self.at >= len(self.data) and not self.inflate.eof:
                return 0


def _whole(x):
    return int(x) if x and x.lstrip("-").isdigit() else None


def _records(content: bytes) -> Iterator[tuple]:
    """The fields of ``RECORD`` of each record of an archive."""
    packed = content[:2] == b"\x1f\x8b"
    stream = io.BufferedReader(_Inflate(content), 1 << 20) if packed else io.BytesIO(content)
    for h, block in parse(stream):
        kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        size = intact = page = refers = None
        if kind in ("response", "revisit") and h.get("content-type", "").startswith("application/http"):
            head, _, block = block.partition(b"\r\n\r\n")
            encoded = b"\r\ntransfer-encoding:" in head.lower()
        else:
            encoded = False
        if kind == "response":
            size, own = len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()
            intact = None if encoded else digest in (None, own)
            digest = digest or own
        elif kind == "metadata":
            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines())}
            size, page, refers = (_whole(fields.get(k)) for k in ("payload-bytes", "page-id", "refers-to-page"))
        beside = [x for x in h.get("warc-concurrent-to", "").split("\n") if x]
        yield kind, h.get("warc-record-id"), beside, h.get("warc-target-uri"), h.get("warc-refers-to"), page, refers, digest, size, intact, block


def _in_batches(rows: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (bytes, row), of about ``_BATCH`` bytes."""
    out, held = [], 0
    for size, row in rows:
        out.append(row)
        held += size + 400
        if held > _BATCH:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in RECORD.split(", "))])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((len(r[-1]), dict(zip(_NAMES, r, strict=True))) for batch in batches for x in batch.column("content") for r in _records(x.as_py()))
    yield from _in_batches(rows, _SCHEMA)


#: Fields of the nested records, by their names in RECORD.
PARTS = {
    "request": {"record_id": "record_id", "uri": "uri", "block": "block"},
    "response": {"record_id": "record_id", "record_type": "kind", "uri": "uri", "payload_digest": "payload_digest", "payload_bytes": "payload_bytes", "refers_to_record": "refers_to_record", "intact": "intact", "payload": "block"},
    "metadata": {"record_id": "record_id", "page_id": "page_id", "payload_bytes": "payload_bytes", "refers_to": "refers_to"},
}
_KINDS = dict(x.split() for x in RECORD.split(", "))
TRANSACTION = "page_id long, " + ", ".join(f"{part} struct<{', '.join(f'{to}: {_KINDS[of]}' for to, of in fields.items())}>" for part, fields in PARTS.items())
_NESTED = [pa.field("page_id", pa.int64()), *(pa.field(part, pa.struct([(to, _TYPES[_KINDS[of]]) for to, of in fields.items()])) for part, fields in PARTS.items())]


def _taken(part: str, record: tuple) -> dict:
    r = dict(zip(_NAMES, record, strict=True))
    return {to: r[of] for to, of in PARTS[part].items()}


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(capture, record): the captures whose three records lie in one file, nested; all other records as they are."""
    kind, at, beside, block = (_NAMES.index(c) for c in ("kind", "record_id", "concurrent_to", "block"))

    def rows():
        for batch in batches:
            for content in batch.column("content"):
                records = list(_records(content.as_py()))
                place, linked = {r[at]: i for i, r in enumerate(records)}, {}
                for i, r in enumerate(records):
                    for j in (place[x] for x in r[beside] if x in place):
                        linked.setdefault(i, set()).add(j)
                        linked.setdefault(j, set()).add(i)
                used = set()
                for i, r in enumerate(records):
                    if r[kind] in ("response", "revisit"):
                        of = {k: [j for j in linked.get(i, ()) if records[j][kind] == k] for k in ("request", "metadata")}
                        if all(of.values()) and all(len(linked[j]) == 1 for js in of.values() for j in js):
                            used |= {i, *of["request"], *of["metadata"]}
                            request, metadata = (records[min(of[k], key=lambda j: records[j][at])] for k in ("request", "metadata"))  # noqa: B023
                            capture = {"request": _taken("request", request), "response": _taken("response", r), "metadata": _taken("metadata", metadata)}
                            yield len(r[block]), {"capture": capture | {"page_id": capture["metadata"]["page_id"]}, "record": None}
                yield from ((len(r[block]), {"capture": None, "record": dict(zip(_NAMES, r, strict=True))}) for i, r in enumerate(records) if i not in used)

    yield from _in_batches(rows(), pa.schema([("capture", pa.struct(_NESTED)), ("record", pa.struct(list(_SCHEMA)))]))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata, joined where either names the other as concurrent.

    A capture without request or metadata has null there; of several the one of the smallest
    identifier stands. ``records`` is read several times: pass a stored table.
    """
    part = lambda *kinds: records.where(F.col("kind").isin(*kinds))
    main = part("response", "revisit")
    named = F.explode("concurrent_to").alias("other")

    def beside(kind: str, fields: list) -> DataFrame:
        """(id of a capture, its record of that kind)"""
        own = part(kind).select("record_id", F.struct("record_id", *fields).alias(kind), "concurrent_to")
        naming = own.select(F.explode("concurrent_to").alias("id"), kind)
        links = main.where(F.size("concurrent_to") > 0).select(F.col("record_id").alias("id"), named)
        both = naming.union(links.join(own.select(F.col("record_id").alias("other"), kind), "other").select("id", kind))
        return both.groupBy("id").agg(F.min_by(kind, F.col(f"{kind}.record_id")).alias(kind))

    capture = main.select(
        F.col("record_id").alias("id"),
        F.struct("record_id", F.col("kind").alias("record_type"), "uri", "payload_digest", "payload_bytes", "refers_to_record", "intact", F.col("block").alias("payload")).alias("response"),
    )
    request, metadata = beside("request", ["uri", "block"]), beside("metadata", ["page_id", "payload_bytes", "refers_to"])
    return capture.join(request, "id", "left").join(metadata, "id", "left").select("metadata.page_id", "request", "response", "metadata")


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """``transactions`` of the archives in ``path``, joined while reading where a capture's records lie in one file."""
    files = spark.read.format("binaryFile").load(path).select("content")
    both = files.mapInArrow(_assembled, f"capture struct<{TRANSACTION}>, record struct<{RECORD}>")
    left = stored(both.where("record is not null and record.kind in ('request', 'response', 'revisit', 'metadata')").select("record.*"), "warc-records")
    whole = both.where("capture is not null").select("capture.*")
    return whole if left.isEmpty() else whole.unionByName(transactions(left))


def report(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path)
    return read_transactions(spark, path).select(
        "page_id",
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("metadata.refers_to").alias("refers_to"),
    )
