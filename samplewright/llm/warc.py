"""Legacy archives (ARC 1 and 2) to WARC 1.1, and both kinds of archive written and read.

Archives are read file by file, as a stream: header lines of the version that the
file declares, then as many bytes as they declare. A first pass makes an index of
the records without payloads; records with equal payloads get one response and
revisits of it. A second pass writes the responses with their payloads; revisits
are written from the index alone. Identifiers, timestamps, types and digests of
the WARC records follow from the ARC records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, erase_path, shared_path, written

#: Fixed values of the formats: header fields of a URL record by version of ARC, and the end of a WARC record.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a header line of a version looks like. URLs and types in old archives hold spaces, so the line is read from both ends.
ARC_LINE = {
    1: re.compile(rb"(.*) (\S+) (\d{8,17}) (.*) (\d+)$"),
    2: re.compile(rb"(.*) (\S+) (\d{8,17}) (.*) (\d{3}|-) (\S+) (\S+) (\d+|-) (\S+) (\d+)$"),
}
#: Revisits whose keys may be sent to all tasks.
SENT_KEYS = 1 << 20
#: Bytes of records that a task holds before it passes them on.
HELD = 1 << 22


class Stream:
    """The bytes of a file, unpacked piece by piece if they are gzip members."""

    def __init__(self, content: bytes, piece: int = 1 << 18):
        self.content, self.piece, self.read, self.at, self.start = memoryview(content), piece, 0, 0, 0
        self.packed = content[:2] == b"\x1f\x8b"
        self.unpack, self.buffer = zlib.decompressobj(31), bytearray()

    @property
    def offset(self) -> int:
        """Place in the unpacked file."""
        return self.start + self.at

    def _more(self) -> bool:
        if self.read >= len(self.content):
            return False
        data = self.content[self.read : self.read + self.piece]
        self.read += len(data)
        if self.at > self.piece:
            del self.buffer[: self.at]
            self.start, self.at = self.start + self.at, 0
        if not self.packed:
            self.buffer += data
            return True
        data = bytes(data)
        while data:
            self.buffer += self.unpack.decompress(data)
            data = self.unpack.unused_data
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """The next line without its end, None at the end of the file."""
        seen = self.at
        while (end := self.buffer.find(b"\n", seen)) < 0:
            left = len(self.buffer) - self.at
            if not self._more():
                if not left:
                    return None
                end = len(self.buffer)
                break
            seen = self.at + left
        out = bytes(self.buffer[self.at : end])
        self.at = min(end + 1, len(self.buffer))
        return out.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the file."""
        while len(self.buffer) - self.at < n and self._more():
            pass
        out = bytes(self.buffer[self.at : self.at + n])
        self.at += len(out)
        return out


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(digits: str, otherwise: str) -> str:
    """A WARC timestamp from an ARC date of 14 digits; shorter ones are filled up, invalid ones replaced."""
    d = digits[:14] + "00000101000000"[len(digits[:14]) :]
    fine = "01" <= d[4:6] <= "12" and "01" <= d[6:8] <= "31" and d[8:10] < "24" and d[10:12] < "60" and d[12:14] < "61"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z" if fine else otherwise


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its empty line, payload, and header fields by lower-case name, of an HTTP response; all payload if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    end = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block, b"") if end is None else (block[: end.end()], block[end.end() :])
    fields = (line.split(":", 1) for line in head.decode("latin-1").splitlines()[1:] if ":" in line)
    return head, payload, {k.strip().lower(): v.strip() for k, v in fields}


def arc_records(content: bytes) -> Iterator[dict]:
    """The records of an ARC file: archive, version, offset, url, ip, date (WARC form), mime, block, whole.

    A line that is no header of the version is passed over; a record that ends
    before its declared length is not whole.
    """
    s = Stream(content)
    first = s.line()
    if first is None:  # an empty file
        return
    m = re.match(rb"filedesc://(\S*) .*?(\d{8,17}) .* (\d+)$", first)
    if m is None:
        raise ValueError(f"not an ARC file: {first[:80]!r}")
    archive, day, declared = m[1].decode("latin-1"), iso_date(m[2].decode(), "1970-01-01T00:00:00Z"), s.take(int(m[3]))
    version = int(re.match(rb"\s*(\d+)", declared)[1])
    if version not in ARC_LINE:
        raise ValueError(f"ARC version {version} is not known")
    while True:
        at = s.offset
        line = s.line()
        if line is None:
            return
        m = ARC_LINE[version].match(line)
        if m is None:
            continue
        url, ip, date, mime = (m[k].decode("utf-8", "replace") for k in range(1, 5))
        length = int(m[m.re.groups])
        block = s.take(length)
        yield {"archive": archive, "version": version, "offset": at, "url": url, "ip": ip, "date": iso_date(date, day), "mime": mime, "block": block, "whole": len(block) == length}


def record_id(file: str, offset: int) -> str:
    """The same identifier for the same ARC record, on every try of a task."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}')}>"


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record but for its end; fields without a value are left out."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def response_record(r: dict) -> bytes:
    """The WARC record of an ARC record with its payload: response for HTTP, resource for other schemes."""
    head, payload, _ = http_parts(r["block"])
    http = bool(head)
    fields = [
        ("WARC-Type", "response" if http else "resource"), ("WARC-Record-ID", record_id(r["file"], r["offset"])), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]),
        ("WARC-IP-Address", None if r["ip"] in ("0.0.0.0", "-") else r["ip"]), ("WARC-Block-Digest", f"sha1:{sha1_base32(r['block'])}"), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Truncated", None if r["whole"] else "unspecified"), ("Content-Type", "application/http; msgtype=response" if http else r["mime"]),
    ]
    return warc_record(fields, r["block"])


def revisit_record(r: dict) -> bytes:
    """A revisit: the HTTP head alone, and what it revisits."""
    fields = [
        ("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(r["file"], r["offset"])), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", None if r["ip"] in ("0.0.0.0", "-") else r["ip"]),
        ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(r["to_file"], r["to_offset"])), ("WARC-Refers-To-Target-URI", r["to_url"]), ("WARC-Refers-To-Date", r["to_date"]),
        ("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("WARC-Truncated", "length"), ("Content-Type", "application/http; msgtype=response" if r["head"] else r["mime"]),
    ]
    return warc_record(fields, r["head"])


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of the records of a WARC file, by declared lengths."""
    s = Stream(content)
    while (line := s.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while line := s.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, s.take(int(fields["content-length"]))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about HELD bytes."""
    held, full = [], 0
    for r in rows:
        held.append(r)
        full += size(r)
        if full > HELD or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, full = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of a folder, one row a file. Spark holds a file of up to 2 GB as one value."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _opened(b: pa.RecordBatch) -> Iterator[dict]:
    """The records of the ARC files of a batch; file tells archives of one name apart."""
    for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
        for r in arc_records(content.as_buffer()):
            yield {**r, "file": path}


def _head_first(rows: DataFrame, head: Column) -> DataFrame:
    """rows (record binary) as text, the first row of every partition led by a head: each file that a writer makes of a partition begins with it."""
    place = F.monotonically_increasing_id()
    first = F.pmod(place, F.lit(1 << 33)) == 0
    return rows.select(F.when(first, F.concat(head, F.col("record"))).otherwise(F.col("record")).cast("string").alias("value"))


def write_arc(records: DataFrame, path: str, name: str = "crawl", day: str = "20050101000000") -> None:
    """Writes (url string, ip string, date string of 14 digits, mime string, block binary) as gzipped ARC files, one for each partition; every other one is of version 2.

    White space and control characters of URLs are written as %20.
    """
    file = F.concat(F.lit(f"{name}-"), F.lpad(F.spark_partition_id().cast("string"), 5, "0"), F.lit(".arc"))
    version = F.spark_partition_id() % 2 + 1
    about = {v: f"{v} 0 samplewright\n{fields}\n" for v, fields in ARC_FIELDS.items()}
    lines = {
        1: F.concat(F.lit("filedesc://"), file, F.lit(f" 0.0.0.0 {day} text/plain {len(about[1])}\n{about[1]}\n")),
        2: F.concat(F.lit("filedesc://"), file, F.lit(f" 0.0.0.0 {day} text/plain 200 - - 0 "), file, F.lit(f" {len(about[2])}\n{about[2]}\n")),
    }
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    front = F.concat(url, F.lit(" "), F.col("ip"), F.lit(" "), F.col("date"), F.lit(" "), F.col("mime"), F.lit(" "))
    back = F.concat(F.octet_length("block").cast("string"), F.lit("\n"))
    line = F.when(version == 1, F.concat(front, back)).otherwise(F.concat(front, F.lit("200 - - 0 "), file, F.lit(" "), back))
    own = records.select(F.concat(line.cast("binary"), F.col("block")).alias("record"))
    head = F.when(version == 1, lines[1]).otherwise(lines[2]).cast("binary")
    _head_first(own, head).write.option("compression", "gzip").text(path)  # the line feed after a value is ARC's own separator


INDEX = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("head", pa.binary()),
    ("page_id", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string()), ("sha256", pa.binary()), ("whole", pa.bool_()),
])
PAGE_ID = "X-Page-Id"


def page_number(fields: dict[str, str]) -> int | None:
    value = fields.get(PAGE_ID.lower(), "")
    return int(value) if re.fullmatch(r"-?\d{1,19}", value) else None


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files without their payloads, written: place, header fields, HTTP head, length and digests of the payload."""

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for r in _opened(b):
            head, payload, fields = http_parts(r["block"])
            yield r["file"], r["offset"], r["url"], r["ip"], r["date"], r["mime"], head, page_number(fields), len(payload), sha1_base32(payload), hashlib.sha256(payload).digest(), r["whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches(rows(b), INDEX, lambda r: 300 + len(r[6]))

    schema = "file string, offset bigint, url string, ip string, date string, mime string, head binary, page_id bigint, bytes bigint, digest string, sha256 binary, whole boolean"
    return written(_files(spark, path).mapInArrow(run, schema), "arc-index")


def decided(index: DataFrame, least: int = 0) -> DataFrame:
    """index with kind and the response that a revisit refers to (to_file, to_offset, to_url, to_date).

    Of whole records with equal payloads (SHA-256 and length) of at least `least`
    bytes, the one with the largest page id is the response (null is the smallest;
    of equal ids the first by file and place), the others revisit it.
    """
    joins = F.col("whole") & (F.col("bytes") >= least)
    first = F.struct(F.coalesce(-F.col("page_id").cast("decimal(20,0)"), F.lit(1e20).cast("decimal(38,0)")).alias("o"), "file", "offset", "url", "date")
    to = [F.col(f"to.{c}").alias(f"to_{c}") for c in ("file", "offset", "url", "date")]
    classes = index.filter(joins).groupBy("sha256", "bytes").agg(F.count("*").alias("n"), F.min(first).alias("to")).filter("n > 1").select("sha256", "bytes", "n", *to)
    met = attach(index, written(classes, "payload-classes"), ["sha256", "bytes"], "n", index.count())
    own = (F.col("file") == F.col("to_file")) & (F.col("offset") == F.col("to_offset"))
    return met.withColumn("kind", F.when(joins & F.col("n").isNotNull() & ~own, F.lit("revisit")).otherwise(F.lit("response"))).drop("n")


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """Converts the ARC files of a folder into gzipped WARC files, each led by a warcinfo record."""
    typed = written(decided(arc_index(spark, arc_path), least), "arc-decided")
    revisits = typed.filter("kind = 'revisit'")
    columns = ["file", "offset", "url", "ip", "date", "mime", "head", "digest", "to_file", "to_offset", "to_url", "to_date"]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([revisit_record(r) for r in b.to_pylist()], pa.binary())], ["record"])

    places = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record", pa.binary())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((r["file"], r["offset"], response_record(r)) for r in _opened(b))
            yield from _batches(rows, places, lambda r: len(r[2]))

    keys = revisits.select("file", "offset")
    few = keys.count() <= SENT_KEYS
    responses = _files(spark, arc_path).mapInArrow(whole, "file string, offset bigint, record binary").join(F.broadcast(keys) if few else keys, ["file", "offset"], "left_anti")
    both = responses.select("record").unionByName(revisits.select(*columns).mapInArrow(again, "record binary"))
    part = F.lpad(F.spark_partition_id().cast("string"), 5, "0")
    block = "software: samplewright\r\nformat: WARC File Format 1.1\r\n"
    name = F.concat(F.lit("<urn:uuid:00000000-0000-5000-8000-0000000"), part, F.lit(">"))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: 2005-01-01T00:00:00Z\r\nWARC-Record-ID: "), name, F.lit(f"\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n{block}{END}"))
    _head_first(both, head.cast("binary")).write.option("compression", "gzip").option("lineSep", END).text(warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, date, url, page_id, payload_bytes, payload_digest, refers_to_id, refers_to, intact) of all records but warcinfo.

    Length and digest are those of the full payload: counted for records that hold
    it. A revisit has the length and the page id (refers_to) of the record that it
    refers to; where the folder does not hold that one, the length that its HTTP head
    declares, or null. intact: the declared digest is that of the payload.
    """
    records = written(_read_records(spark, path), "warc-records")
    referred = records.filter("refers_to_id is not null").groupBy("refers_to_id").agg(F.count("*").alias("n"))
    names = [F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full")]
    named = written(referred.join(records.select(*names), "refers_to_id"), "warc-referred")
    size = F.coalesce("full", "payload_bytes").alias("payload_bytes")
    met = attach(records, named, "refers_to_id", "n", records.count())
    return met.select("record_id", "record_type", "date", "url", "page_id", size, "payload_digest", "refers_to_id", "refers_to", "intact")


def _read_records(spark: SparkSession, path: str) -> DataFrame:
    names = ["record_id", "record_type", "date", "url", "page_id", "payload_bytes", "payload_digest", "refers_to_id", "intact"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for content in b.column("content"):
            for fields, block in warc_records(content.as_buffer()):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                _, payload, http = http_parts(block)
                declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                if kind == "revisit":
                    said = http.get("content-length", "")
                    size, digest = int(said) if said.isdigit() else None, declared
                else:
                    size, digest = len(payload), sha1_base32(payload)
                yield fields["warc-record-id"], kind, fields["warc-date"], fields.get("warc-target-uri"), page_number(http), size, digest, fields.get("warc-refers-to"), digest == declared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches(rows(b), schema, lambda r: 400)

    columns = "record_id string, record_type string, date string, url string, page_id bigint, payload_bytes bigint, payload_digest string, refers_to_id string, intact boolean"
    return _files(spark, path).mapInArrow(run, columns)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages as ARC records: an HTTP response each, its payload the UTF-8 of the page (null: empty), dated by page id from 2005 on.

    A null url becomes urn:page:<id>, a null id has no header of its own.
    """
    number = F.col(id_col).cast("long")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    own = F.when(number.isNotNull(), F.concat(F.lit(f"{PAGE_ID}: "), number.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), own, F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit(END))
    seconds = F.timestamp_seconds(F.lit(1_104_537_600) + F.pmod(F.coalesce(number, F.lit(0)), F.lit(600_000_000)))
    date = F.date_format(F.to_utc_timestamp(seconds, F.current_timezone()), "yyyyMMddHHmmss")
    url = F.coalesce(F.nullif(F.trim(F.col(url_col).cast("string")), F.lit("")), F.concat(F.lit("urn:page:"), F.coalesce(number.cast("string"), F.lit("none"))))
    return pages.select(url.alias("url"), F.lit("0.0.0.0").alias("ip"), date.alias("date"), F.lit("text/html").alias("mime"), F.concat(head.cast("binary"), payload).alias("block"))


def converted(pages: DataFrame, least: int = 0, **columns: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row per page, read back from WARC.

    The pages are written as ARC archives of both versions, converted, and the WARC
    archives read again. refers_to: the page id of the response that a revisit
    refers to, else null. A null page is an empty payload; empty payloads count
    as equal; rows that repeat a page id are records of their own. An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(page_records(pages, **columns), arc)
    arc_to_warc(spark, arc, warc, least)
    erase_path(spark, arc)
    got = written(read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-pages")
    erase_path(spark, warc)
    return got


def warc_sql() -> str:
    """The result for pages in DuckDB's SQL; base32 digits come from 20 bits, five hex digits, at a time."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)"
    return f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t FROM pages
), d AS (
  SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h, first_value(page_id) OVER w AS top, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY t ORDER BY page_id DESC NULLS LAST)
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: {digit}), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM d
"""
