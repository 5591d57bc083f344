"""WARC archives: writing captures, and assembling them again from their records.

Writing gives each page a `response` or `revisit` record with a `request` and a `metadata` record beside it, tied by
WARC-Concurrent-To. Reading parses the archive files by Content-Length and joins the records of a capture through those
identifiers into one nested row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path

#: Payloads below this many bytes are always stored whole.
LEAST_REVISIT_BYTES = 1000
FILE_RECORDS = 4000
_EOL = "\r\n"
_CHUNK = 1 << 20
#: Headers of responses and revisits: page_id, and that of the response that a revisit repeats.
_PAGE, _REFERS_TO_PAGE = "X-Page-ID", "X-Refers-To-Page-ID"
_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.string()), ("body", pa.binary())])
RECORD_SCHEMA = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, headers map<string,string>, http_headers string, body binary"


def plan_captures(pages: DataFrame) -> DataFrame:
    """Adds capture (a number of each row's own), payload_bytes, payload_digest, and refers_to and refers_to_capture (page_id
    and capture of the response that a revisit repeats: the largest page_id with that payload).

    Rows with a null page_id are responses, and so are all rows that have the page_id referred to. Captures are numbered by
    partition and place in `pages`, which must be the same whenever it is read, as those of files are.
    Only digests that occur twice are joined back; their maximum is taken before the shuffle, and the join is one whose
    large partitions adaptive execution splits, so a payload that a third of all pages share is no bottleneck.
    """
    p = pages.select(F.monotonically_increasing_id().alias("capture"), "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8")))
    again = p.where(F.col("payload_bytes") >= LEAST_REVISIT_BYTES).groupBy("payload_digest").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "capture"))).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = p.join(again, "payload_digest", "left")
    repeats = (F.col("payload_bytes") >= LEAST_REVISIT_BYTES) & (F.col("kept.page_id") != F.col("page_id"))
    return p.withColumns({"refers_to": F.when(repeats, F.col("kept.page_id")), "refers_to_capture": F.when(repeats, F.col("kept.capture"))}).drop("kept")


def _uid(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"<urn:capture:{kind}:"), key.cast("string"), F.lit(">"))


def _fields(*pairs) -> F.Column:
    """Header lines; a pair with a null value is left out."""
    return F.concat_ws(_EOL, *[F.concat(F.lit(f"{k}: "), v) for k, v in pairs])


def _record(head, block) -> F.Column:
    return F.concat(F.lit(f"WARC/1.1{_EOL}"), head, F.lit(f"{_EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(_EOL * 2), block)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write gzipped archives under `path`.

    A record is text ending in two empty lines, so Spark's own text writer with that line separator makes valid archives
    through any file system. Null url and html are empty. Identifiers hold the capture's number, so every row is a capture,
    whether its page_id is repeated or null; page_id is a header of its own, which is left out where it is null.
    """
    p = plan_captures(pages)
    # a header line must not be broken by its value
    uri = F.regexp_replace("url", r"[\r\n\x00]", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_EOL * 2))
    revisit = F.col("refers_to").isNotNull()
    own, digest = _uid("page", F.col("capture")), F.concat(F.lit("sha1:"), "payload_digest")
    common = (("WARC-Target-URI", uri), ("WARC-Date", F.lit(date)))
    main = _record(
        _fields(
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest),
            ("X-Payload-Length", F.col("payload_bytes").cast("string")), (_PAGE, F.col("page_id").cast("string")), (_REFERS_TO_PAGE, F.col("refers_to").cast("string")),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("WARC-Refers-To", F.when(revisit, _uid("page", F.col("refers_to_capture")))), ("Content-Type", F.lit("application/http; msgtype=response")),
        ),
        F.when(revisit, http).otherwise(F.concat(http, "html")),
    )
    asked = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{_EOL}Accept: text/html{_EOL * 2}"))
    request = _record(_fields(("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uid("request", F.col("capture"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))), asked)
    about = F.concat(F.lit("fetched-by: tidemark\r\npayload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(_EOL))
    metadata = _record(_fields(("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uid("metadata", F.col("capture"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))), about)
    # explode would need an array of three whole records; one row of three records in their order is the same bytes
    p.select(F.concat_ws(_EOL * 2, request, main, metadata).alias("value")).write.option("lineSep", _EOL * 2).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """An archive's bytes in chunks of up to a megabyte: all members of a gzip file one after another, or the file as it is."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + _CHUNK] for at in range(0, len(data), _CHUNK))
        return
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            chunk = member.decompress(data, _CHUNK)
            data = member.unused_data if member.eof else member.unconsumed_tail
            yield chunk
            if not chunk and not data and not member.eof:
                return  # cut short: what was whole has been given


class _Bytes:
    """Reads ahead in chunks, and holds no more than is asked for and a chunk."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        self.held += chunk or b""
        return chunk is not None

    def starts(self, mark: bytes) -> bool:
        while len(self.held) < len(mark) and self.more():
            pass
        return self.held.startswith(mark)

    def upto(self, end: bytes) -> bytes | None:
        """What stands before `end`, which is passed over; None if it doesn't come."""
        looked = 0
        while (at := self.held.find(end, looked)) < 0:
            looked = max(0, len(self.held) - len(end))
            if not self.more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(end)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _header_lines(text: str) -> list[tuple[str, str]]:
    """(name, value) of lines split at the first colon; a line that begins with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, gzipped (in one member or one for each record) or not; blocks are taken by Content-Length.

    Names of headers may be in any case, HTTP headers hold any bytes. Raises ValueError where a record is broken or cut short,
    when the whole ones before it have been given.
    """
    source, n = _Bytes(_inflated(data)), 0
    while True:
        while source.starts(b"\r\n"):
            source.take(2)
        if not source.starts(b"WARC/"):
            if source.held:
                raise ValueError(f"no record after {n}")
            return
        raw = source.upto(b"\r\n\r\n")
        pairs = _header_lines((raw or b"").decode("utf-8", "replace").split("\r\n", 1)[-1])
        head = {name.lower(): value for name, value in pairs}
        if raw is None or not head.get("content-length", "").isdigit():
            raise ValueError(f"record {n + 1} has no length")
        length = int(head["content-length"])
        block = source.take(length)
        if len(block) != length:
            raise ValueError(f"record {n + 1} is cut short")
        http, body = "", block
        if head.get("content-type", "").startswith("application/http"):
            first, _, body = block.partition(b"\r\n\r\n")
            http = first.decode("latin-1")
        digest, size = head.get("warc-payload-digest"), head.get("x-payload-length", "")
        yield {
            "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type", "").lower() or None, "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"),
            "payload_digest": digest.removeprefix("sha1:") if digest else None, "payload_bytes": int(size) if size.isdigit() else None, "headers": list(dict(pairs).items()), "http_headers": http, "body": body,
        }
        n += 1


def _records(data: bytes) -> Iterator[dict]:
    """The records of an archive and, where it is broken, a last one of type `broken`, as one file must not end a job over many."""
    try:
        yield from parse_archive(data)
    except (ValueError, zlib.error):
        yield dict.fromkeys(_RECORD.names) | {"record_type": "broken", "headers": [], "http_headers": "", "body": b""}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content"):
            rows, held = [], 0
            for row in _records(data.as_py()):
                rows.append(row)
                held += len(row["body"])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _RECORD)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under `path`: files as `write_archives` makes them, *.warc and *.warc.gz.

    A file is inflated a megabyte at a time; what is held is its bytes as they are stored, and one record. A broken archive has
    a last row of type `broken`, after its whole records.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt.gz,warc,warc.gz}").load(path).select("content")
    return files.mapInArrow(_parse, RECORD_SCHEMA)


def assemble(records: DataFrame, bodies: bool = True) -> DataFrame:
    """One nested row for each capture: its response or revisit record with the request and metadata concurrent to it.

    Captures without one of them have null there; a request or metadata record that names no capture is dropped, and of
    several the one with the smallest record_id counts. Records are brought together by the capture's identifier, which
    is unique, so no key is hot.
    """
    part = F.struct("record_id", "record_type", "target_uri", "http_headers", "headers", *(["body"] if bodies else []))
    key = F.when(F.col("record_type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    is_main = F.col("record_type").isin("response", "revisit")
    pick = lambda cond: F.min_by(F.when(cond, part), F.when(cond, F.col("record_id")))
    header = lambda name: F.try_element_at("headers", F.lit(name)).cast("long")
    main = F.struct("record_id", "record_type", header(_PAGE).alias("page_id"), header(_REFERS_TO_PAGE).alias("refers_to_page"), "refers_to", "target_uri", "payload_digest", "payload_bytes", "http_headers", *(["body"] if bodies else []))
    got = records.withColumn("capture_id", key).groupBy("capture_id").agg(F.min_by(F.when(is_main, main), F.when(is_main, F.col("record_id"))).alias("response"), pick(F.col("record_type") == "request").alias("request"), pick(F.col("record_type") == "metadata").alias("metadata"))
    return got.where("response is not null")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write `pages` as archives in the shared folder, read them back and give the digest columns of each capture.

    Digest and length are those of the full payload; for responses both are computed again from the bytes that were read.
    """
    path = new_path(spark, "warc")
    write_archives(pages, path)
    whole = F.col("record_type") == "response"
    records = read_records(spark, path).withColumn("payload_digest", F.when(whole, F.sha1("body")).otherwise(F.col("payload_digest"))).withColumn("payload_bytes", F.when(whole, F.octet_length("body").cast("long")).otherwise(F.col("payload_bytes")))
    got = assemble(records, bodies=False)
    return got.select(
        F.col("response.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to_page").alias("refers_to"),
        F.col("request.http_headers").alias("request_line"), F.col("metadata.record_id").isNotNull().alias("has_metadata"),
    )
