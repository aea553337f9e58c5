"""Web archives: legacy ARC files of versions 1 and 2, their conversion to WARC, and reading of both.

An ARC file begins with a version block that names the fields of its header lines; every record is a header line and as many
bytes as it declares. Each becomes a WARC record with an identifier made from its file and place, an ISO date, a type, and digests.
Archives are written by Spark's text writer, whose line end is the record's end, so they lie wherever Spark can write, and
they are read as whole files record by record.
"""

import base64
import datetime
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_groups, scratch_path

#: The fields of the header lines of both versions.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of pages that have none.
UNDATED = "20000101000000"
#: Revisits (rows of fixed width, under 200 bytes) that may be broadcast to the records; beyond it they are joined by shuffle.
BROADCAST_REVISITS = 200_000
#: Bytes of records that leave a task at once.
BATCH_BYTES = 8 << 20
META = "record_id string, kind string, uri string, ip string, date string, content_type string, page_id string, payload_bytes long, payload_digest string, payload_key binary, block_digest string, head_digest string, truncated boolean"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(url: str | None) -> str:
    """A URL as one field of a line: white space and control characters are percent-encoded; none is `unknown:`."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029\u3000]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "unknown:"


def _version_block(version: int, name: str) -> bytes:
    block = f"{version} 0 quire\n{FIELDS[version]}\n".encode()
    extra = "text/plain 200 - - 0 " + name if version == 2 else "text/plain"
    return f"filedesc://{name} 0.0.0.0 {UNDATED} {extra} {len(block)}\n".encode() + block


def _arc_record(version: int, url: str | None, page_id, html: str | None, name: str) -> bytes:
    body = (html or "").encode()
    own = "" if page_id is None else f"X-Page-Id: {_plain(str(page_id))}\r\n"
    doc = f"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode() + body
    extra = f"text/html 200 - - 0 {name}" if version == 2 else "text/html"
    return f"{_plain(url)} 0.0.0.0 {UNDATED} {extra} {len(doc)}\n".encode() + doc


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2)) -> None:
    """Writes pages (page_id, url, html) as ARC files, one a partition, gzipped, of these versions in turn."""

    def records(batches):
        part = TaskContext.get().partitionId()
        version, name = versions[part % len(versions)], f"quire-{part:05d}.arc"
        out, size = [_version_block(version, name)], 0
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(_arc_record(version, url, page_id, html, name))
                size += len(out[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = pages.select("page_id", "url", "html").mapInArrow(records, "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _stream(content: bytes):
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def arc_records(content: bytes):
    """(fields by lower-cased name, body, version) of the records of one ARC file, plain or gzipped, the version block first. Lines that are no header
    are passed over; a body that the file's end cuts off is given as far as it goes."""
    stream, version, names = _stream(content), 1, FIELDS[1].lower().split()
    while line := stream.readline():
        head = line.rstrip(b"\r\n")
        if not head.strip():
            continue
        described = head.startswith(b"filedesc:")
        # the version block's own line has its version's fields too, which its body names only later
        parts = head.split(b" ") if described else head.rsplit(b" ", len(names) - 1)
        if len(parts) < (5 if described else len(names)) or not parts[-1].isdigit():
            continue
        body = stream.read(int(parts[-1]))
        if described:
            lines = body.decode("latin-1").splitlines()
            version = int(lines[0].split()[0]) if lines and lines[0].split() and lines[0].split()[0].isdigit() else 1
            names = (lines[1] if len(lines) > 1 else FIELDS.get(version, FIELDS[1])).lower().split()
            parts = [parts[0], *parts[1:4], *([b"-"] * (len(names) - 5)), parts[-1]]
        fields = {k: v.decode("utf-8", "replace") for k, v in zip(names, parts, strict=True)}
        yield fields, body, version


def warc_date(digits: str) -> str:
    """An ISO date from up to 14 digits; missing ones are the smallest; what is no date is UNDATED's."""
    digits = digits if re.fullmatch(r"\d{4,14}", digits or "") else UNDATED
    whole = digits + "00000101000000"[len(digits) :]
    try:
        return datetime.datetime.strptime(whole, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return warc_date(UNDATED)


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(head with its empty line, payload, headers by lower-cased name) of an HTTP message; without a head all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    cut_at = re.search(rb"\r?\n\r?\n", block)
    end = cut_at.end() if cut_at else len(block)
    lines = block[:end].decode("latin-1").splitlines()[1:]
    return block[:end], block[end:], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def _converted(bodies: bool):
    """path, content of ARC files in; what META names of each record, and its HTTP head and payload if `bodies`, out."""
    names = [x.split()[0] for x in META.split(", ")] + (["head", "payload"] if bodies else [])

    def batch_of(rows):
        types = [pa.binary() if n in ("payload_key", "head", "payload") else pa.int64() if n == "payload_bytes" else pa.bool_() if n == "truncated" else pa.string() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def converted(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size, file = [], 0, path.as_py().rsplit("/", 1)[-1]
                for nth, (fields, body, version) in enumerate(arc_records(content.as_py())):
                    uri, info = fields["url"], fields["url"].startswith("filedesc:")
                    head, payload, said = (b"", f"software: quire\r\nformat: WARC/1.1\r\narc: {uri[11:]}, version {version}\r\n".encode(), {}) if info else http_parts(body)
                    kind = "warcinfo" if info else "response" if head or uri.startswith("dns:") else "resource"
                    content_type = "application/warc-fields" if info else "application/http; msgtype=response" if head else fields.get("content-type") or "application/octet-stream"
                    rows.append((
                        f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{nth}')}", kind, uri, fields.get("ip-address", "0.0.0.0"), warc_date(fields.get("archive-date", "")), content_type, said.get("x-page-id"),
                        len(payload), base32_sha1(payload), hashlib.sha256(payload).digest(), base32_sha1(head + payload), base32_sha1(head), len(body) < int(fields["archive-length"]),
                        *((head, payload) if bodies else ()),
                    ))
                    size += len(body)
                    if size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return converted


def read_arc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """The records of all ARC files in a folder, as WARC describes them."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_converted(bodies), META + (", head binary, payload binary" if bodies else ""))


def revisits(meta: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record_id, first_id, first_date) of the responses whose payload, of least_bytes or more, another one has that comes first: by page_id as a number,
    then as text, those without one last, then by record_id. Payloads count as equal when their SHA-256 and lengths are."""
    known = meta.filter((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes))
    order = F.struct(F.col("page_id").isNull().alias("none"), F.expr("coalesce(try_cast(page_id AS DECIMAL(38, 0)), CAST('99999999999999999999999999999999999999' AS DECIMAL(38, 0)))").alias("number"), "page_id", "record_id")
    groups = known.groupBy("payload_key", "payload_bytes").agg(F.min_by(F.struct("record_id", "date"), order).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("payload_bytes")
    met = join_groups(known.select("record_id", "payload_key"), groups, "payload_key", "n", max(1, known.count()))
    return met.filter("record_id <> first.record_id").select("record_id", F.col("first.record_id").alias("first_id"), F.col("first.date").alias("first_date"))


def write_warc(records: DataFrame, again: DataFrame, path: str) -> None:
    """Writes records (of read_arc) as gzipped WARC files; those in `again` (of revisits) as revisits, without their payload."""
    again = cut(again)
    few = again.count() <= BROADCAST_REVISITS
    met = records.join(F.broadcast(again) if few else again, "record_id", "left").withColumn("again", F.col("first_id").isNotNull())
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    when = lambda c, v: F.when(c, v)
    again_, http = F.col("again"), F.col("kind") != "warcinfo"
    block = F.concat("head", F.when(again_, F.lit(b"")).otherwise(F.col("payload")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again_, "revisit").otherwise(F.col("kind"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", when(http, F.col("uri"))),
        line("WARC-Filename", when(~http, F.substring("uri", 12, 1 << 30))),
        line("WARC-IP-Address", when(http & (F.col("ip") != "0.0.0.0"), F.col("ip"))),
        line("WARC-Payload-Digest", when(http, F.concat(F.lit("sha1:"), "payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(again_, F.col("head_digest")).otherwise(F.col("block_digest")))),
        line("WARC-Profile", when(again_, F.lit(REVISIT))),
        line("WARC-Refers-To", when(again_, F.concat(F.lit("<"), "first_id", F.lit(">")))),
        line("WARC-Refers-To-Date", F.col("first_date")),
        line("WARC-Truncated", when(F.col("truncated"), F.lit("length"))),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.length(block).cast("string")),
        F.lit("\r\n"),
    )
    met.select(F.concat(header.cast("binary"), block).cast("string").alias("record")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def warc_records(content: bytes):
    """(headers by lower-cased name, block) of the records of one WARC file, plain or gzipped."""
    stream = _stream(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


WARC_ROWS = "record_id string, record_type string, page_id string, payload_bytes long, payload_digest string, refers_id string, intact boolean"


def _read_back(batches):
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for headers, block in warc_records(content.as_py()):
                head, payload, said = http_parts(block)
                own = headers.get("warc-type") == "revisit"
                claimed, found = headers.get("warc-payload-digest", "").removeprefix("sha1:"), base32_sha1(payload)
                sound = headers.get("warc-block-digest", "") == f"sha1:{base32_sha1(block)}" and (own or not claimed or claimed == found)
                rows.append((headers.get("warc-record-id", "").strip("<>"), headers.get("warc-type"), said.get("x-page-id"), None if own else len(payload), claimed if own else found, headers.get("warc-refers-to", "").strip("<>") or None, sound))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=[x.split()[0] for x in WARC_ROWS.split(", ")])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """What the records of all WARC files in a folder hold: a response's payload length and digest are measured, a revisit's digest is the one it states;
    intact tells whether the digests in the headers are those of the bytes."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read_back, WARC_ROWS)


def convert(spark: SparkSession, arcs: str, warcs: str, least_bytes: int = 0) -> None:
    """Converts a folder of ARC files to a new folder of WARC files. The files are read twice: for the digests, and for the records."""
    meta = cut(read_arc(spark, arcs, bodies=False).select("record_id", "kind", "date", "page_id", "payload_bytes", "payload_key"))
    write_warc(read_arc(spark, arcs), revisits(meta, least_bytes), warcs)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as ARC files, converted to WARC and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to, intact).

    The payload is the html in UTF-8, of a null empty. Of records with equal payloads of least_bytes or more the one with the smallest page_id is
    the response and the others revisit it; refers_to is its page_id. Payloads under least_bytes are all responses. Of rows with the same
    page_id and payload one is the response; rows without page_id come last and keep none. A null url is `unknown:`, and white space in a url is
    percent-encoded. An empty table gives no row; other columns are not read.
    """
    spark = pages.sparkSession
    arcs, warcs = scratch_path(spark), scratch_path(spark)
    write_arc(pages, arcs)
    convert(spark, arcs, warcs, least_bytes)
    rows = cut(read_warc(spark, warcs).filter("record_type <> 'warcinfo'"))
    pointing = rows.filter("record_type = 'revisit'")
    held = rows.filter("record_type <> 'revisit'")
    named = held.select(F.col("record_id").alias("refers_id"), F.col("payload_bytes").alias("held_bytes"), F.col("page_id").alias("refers_to"))
    found = join_groups(pointing, named.join(pointing.groupBy("refers_id").agg(F.count("*").alias("n")), "refers_id"), "refers_id", "n", max(1, rows.count()))
    out = held.withColumn("refers_to", F.lit(None).cast("string")).unionByName(found.withColumn("payload_bytes", F.col("held_bytes")).drop("held_bytes", "n"))
    kind = pages.schema["page_id"].dataType
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact")
