"""WARC archives as a chunked record table: large payloads travel in segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of a segment, and payload bytes from which equal payloads become revisits.
SEGMENT, REVISIT_FROM = 1 << 18, 1000
END = "\r\n\r\n"
_COLUMNS = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments", "sound")
_SCHEMA = (
    "page_id string, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to string, n_segments int, sound boolean"
)


def _decided(pages: DataFrame, page_id: str, payload: Column) -> DataFrame:
    """``pages`` as (_row, _id, _payload, _bytes, _sha1, _type, _refers).

    Only (id, length, digest) travel to find the largest id of each payload, combined before the
    shuffle; the payloads are joined once, by id and digest, where no hot key can arise.
    """
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), F.col(f"`{page_id}`").alias("_id"),
        payload.alias("_payload"),
    )
    rows = rows.withColumn("_bytes", F.octet_length("_payload").cast("long")).withColumn("_sha1", F.sha1(F.col("_payload").cast("binary")))
    keys = rows.select("_id", "_bytes", "_sha1").groupBy("_id", "_bytes", "_sha1").agg(F.count(F.lit(1)).alias("_n"))
    large = keys.filter(F.col("_bytes") >= REVISIT_FROM).groupBy("_sha1", "_bytes").agg(
        F.max("_id").alias("_last"), F.sum("_n").alias("_copies")
    ).filter("_copies > 1")
    decided = keys.join(large, ["_sha1", "_bytes"]).select(
        F.col("_id").alias("_kid"), F.col("_sha1").alias("_ksha1"), "_last"
    )
    joined = rows.join(decided, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_sha1") == F.col("_ksha1")), "left")
    first = F.col("_ksha1").isNull() | F.col("_id").eqNullSafe(F.col("_last"))
    return joined.select(
        "_row", "_id", "_payload", "_bytes", "_sha1",
        F.when(first, "response").otherwise("revisit").alias("_type"),
        F.when(~first, F.col("_last")).alias("_refers"),
    )


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT,
) -> str:
    """Write a WARC/1.1 record per row of ``pages`` into gzip archives below ``folder``.

    The payload is the html in UTF-8, empty for NULL. Of equal payloads of at least 1000 bytes the
    one with the largest id is a response, the others are revisits that refer to it; rows that
    equal the response in id and payload are responses too, NULL ids come before all others.
    Smaller payloads are all responses. Payloads above ``segment`` code points become a response
    and continuation records of that size, in a row of the record table each, so no record larger
    than that is formed. NULL urls leave their header out; line ends in urls become spaces. Columns
    besides the three are ignored. An empty table gives an archive without records.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = _decided(pages, page_id, payload)
    address = F.regexp_replace(F.col(f"_row.`{url}`"), r"[\r\n]+", " ")
    n = F.greatest(F.lit(1), F.ceil(F.length("_payload") / F.lit(segment)).cast("int"))
    n = F.when(F.col("_type") == "revisit", F.lit(1)).otherwise(n)
    digest = F.concat(F.lit("sha1:"), F.col("_sha1"))
    rows = rows.withColumn("_n", n).withColumn("_no", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    chunk = F.when(F.col("_n") == 1, F.col("_payload")).otherwise(
        F.substr("_payload", (F.col("_no") - 1) * segment + 1, F.lit(segment))
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("_bytes").cast("string"), F.lit(END),
    )
    body = F.when(F.col("_type") == "revisit", http).when(F.col("_no") == 1, F.concat(http, chunk)).otherwise(chunk)
    kind = F.when(F.col("_no") > 1, "continuation").otherwise(F.col("_type"))
    record = rows.withColumn("_body", body).withColumn("_kind", kind)
    own = _uri(F.col("_id"))
    segmented, later = F.col("_n") > 1, F.col("_no") > 1
    part = F.concat(F.lit("<urn:x-page-segment:"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.col("_no").cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("_kind")),
        line("WARC-Record-ID", F.when(later, part).otherwise(own)), line("WARC-Date", F.lit(date)),
        F.when(address.isNotNull(), line("WARC-Target-URI", address)).otherwise(""),
        line("WARC-Payload-Digest", digest),
        F.when(F.col("_type") == "revisit", F.concat(
            line("WARC-Refers-To", _uri(F.col("_refers"))),
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
        )).otherwise(""),
        F.when(segmented, line("WARC-Segment-Number", F.col("_no").cast("string"))).otherwise(""),
        F.when(later, line("WARC-Segment-Origin-ID", own)).otherwise(""),
        F.when(segmented & (F.col("_no") == F.col("_n")), line(
            "WARC-Segment-Total-Length", (F.octet_length(http) + F.col("_bytes")).cast("string")
        )).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("_body").cast("string")), F.lit("\r\n"),
    )
    # a row of text is a record, and what separates the rows is what ends a record
    record.select(F.concat(head, F.col("_body")).alias("value")).write.option("lineSep", END).option(
        "compression", "gzip"
    ).text(folder)
    return folder


class _Records:
    """A parser fed with the lines of archives in order; it keeps digests and lengths, no payload."""

    def __init__(self) -> None:
        self.head: dict[str, str] | None = None
        self.http: dict[str, str] | None = None
        self.left = 0
        self.open: dict | None = None

    def line(self, raw: bytes) -> Iterator[tuple]:
        """Take a line with its ``\\n``; yield the records that are complete."""
        while raw:
            if self.left > 0:
                taken, raw = raw[: self.left], raw[self.left :]
                self.left -= len(taken)
                self._block(taken)
                if self.left == 0:
                    yield from self._end()
            else:
                yield from self._header(raw)
                return

    def _header(self, raw: bytes) -> Iterator[tuple]:
        text = raw.decode("utf-8").rstrip("\r\n")
        if self.head is None:
            if text.startswith("WARC/"):
                self.head = {}
            return
        if text:
            name, _, value = text.partition(":")
            self.head[name.lower()] = value.strip()
            return
        self.left = int(self.head["content-length"])
        kind = self.head["warc-type"]
        if kind != "continuation":
            self.open = {"head": self.head, "sha1": hashlib.sha1(), "bytes": 0, "segments": 0}
            self.http = {}
        self.open["segments"] += 1
        if self.left == 0:
            yield from self._end()

    def _block(self, data: bytes) -> None:
        if self.http is not None:  # the lines of the HTTP header
            text = data.decode("utf-8").rstrip("\r\n")
            if text:
                name, _, value = text.partition(":")
                self.http[name.lower()] = value.strip()
                return
            self.open["http"], self.http = self.http, None
            return
        self.open["sha1"].update(data)
        self.open["bytes"] += len(data)

    def _end(self) -> Iterator[tuple]:
        head, record = self.head, self.open
        self.head = None
        if "warc-segment-number" in head and "warc-segment-total-length" not in head:
            return
        first = record["head"]
        declared = first["warc-payload-digest"].removeprefix("sha1:")
        length = int(record["http"]["content-length"])
        revisit = first["warc-type"] == "revisit"
        found = declared if revisit else record["sha1"].hexdigest()
        size = length if revisit else record["bytes"]
        page = lambda uri: uri.removeprefix("<urn:x-page:").removesuffix(">") or None
        self.open = None
        yield (
            page(first["warc-record-id"]), first.get("warc-target-uri"), size, found, first["warc-type"],
            page(first["warc-refers-to"]) if revisit else None, record["segments"],
            found == declared and size == length,
        )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per WARC record of the archives: page id and url as text, length and bare hexadecimal
    SHA-1 of the whole payload, type, the page a revisit refers to, the number of segments, and
    whether length and digest are the declared ones.

    A gzip file is read by one task, line by line; a digest grows with the chunks, and no record
    is put together. A revisit has the length and digest it declares. Several files may come to
    one task, one after the other.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = _Records()
        for batch in batches:
            found = []
            for line in batch.column(0).to_pylist():
                found.extend(records.line(line.encode() + b"\n"))
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(_COLUMNS, map(list, zip(*found)))), schema=types)

    types = pa.schema([
        ("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
        ("n_segments", pa.int32()), ("sound", pa.bool_()),
    ])
    return spark.read.option("lineSep", "\n").text(folder).mapInArrow(parse, _SCHEMA)
