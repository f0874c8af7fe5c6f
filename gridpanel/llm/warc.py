"""WARC archives with revisit resolution.

Headers are shuffled by payload digest; records whose payload another record
holds become revisits that point to it. Archives are files of gzip members, one
for each record, of a bounded size, written by Spark's own writer; they are read
back by content length, and revisits are joined to the responses they refer to.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_path, join_hot, new_path, small_batches

#: Bytes from which on an equal payload is a revisit; bytes of an archive at most, but for one record more.
REVISIT_BYTES, ARCHIVE_BYTES = 1000, 16 << 20
#: Digests that several records have are marked in 2 ** MARK_BITS bits: a table of 2 ** (MARK_BITS - 6) rows at most.
MARK_BITS = 24
END = b"\r\n\r\n"
#: A gzip member of nothing, which ends each file, as the writer wants something there.
NOTHING = gzip.compress(b"", mtime=0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _marked(digest: Column) -> tuple[Column, Column]:
    """The row of the table of marks that a digest belongs to, and its bit there."""
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    place = F.shiftright(place, 32 - MARK_BITS)
    return F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))


def decided(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, original (struct page_id, url; null unless a revisit).

    Of equal payloads of least_bytes or more the largest page_id is the response
    (all of them, if several rows have it); null is below any page_id, and where
    all are null all are responses. A null html is an empty payload. Headers alone
    are shuffled to find the digests that several records have; payloads then
    move only if their digest is marked as one of these, where a mark may be another's.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    heads = rows.drop("payload").where(F.col("payload_bytes") >= least_bytes)
    same = heads.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("original")).where("n > 1").drop("n")
    same = cut(same.select(F.col("payload_digest").alias("digest"), "original"), "originals")
    at, bit = _marked(F.col("digest"))
    marks = same.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits"))
    at, bit = _marked(F.col("payload_digest"))
    rows = rows.withColumn("at", F.when(F.col("payload_bytes") >= least_bytes, at)).join(F.broadcast(marks), "at", "left")
    met = F.coalesce(F.col("bits").bitwiseAND(bit), F.lit(0)) != 0
    alone = rows.where(~met).drop("at", "bits").withColumn("original", F.lit(None).cast(same.schema["original"].dataType))
    some = join_hot(rows.where(met).drop("at", "bits").withColumn("digest", F.col("payload_digest")), same, ["digest"], "left").drop("digest")
    rows = alone.unionByName(some)
    again = F.col("original").isNotNull() & ~F.col("original.page_id").eqNullSafe(F.col("page_id"))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("payload", F.when(~again, F.col("payload"))).withColumn("original", F.when(again, F.col("original")))


def _record_id(page_id: Column, digest: Column) -> Column:
    """The same for every run: a UUID of page and payload."""
    h = F.md5(F.concat_ws("|", F.lit("record"), F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)), F.lit(">"))


def _uri(url: Column, page_id: Column) -> Column:
    """A header value: white space and control signs escaped; a record without URL gets a name."""
    plain = F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")
    return F.when(F.length(plain) > 0, plain).otherwise(F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))


def _line(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: datetime | None = None) -> None:
    """Write decided() rows as archives of about archive_bytes each, with fresh headers: the date is that of writing unless given."""
    day = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit, length = F.col("record_type") == "revisit", F.col("payload_bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n\r\n"))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    only = lambda c: F.when(revisit, c)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Target-URI", _uri(F.col("url"), F.col("page_id"))),
        _line("WARC-Date", day),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", only(F.lit(PROFILE))),
        _line("WARC-Refers-To", only(_record_id(F.col("original.page_id"), F.col("payload_digest")))),
        _line("WARC-Refers-To-Target-URI", only(_uri(F.col("original.url"), F.col("original.page_id")))),
        _line("WARC-Refers-To-Date", only(F.lit(day))),
        _line("X-Page-Id", F.col("page_id")),
        _line("X-Payload-Length", length),
        _line("Content-Type", "application/http;msgtype=response"),
        _line("Content-Length", size),
        F.lit("\r\n"),
    )
    small_batches(rows.sparkSession)
    packed = rows.select(F.concat(head, http).alias("head"), "payload").mapInArrow(_packed(archive_bytes), "value binary")
    out = packed.select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def _packed(archive_bytes: int):
    """A row per archive: the gzip members of its records, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        full = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])
        for batch in batches:
            for head, payload in zip(batch.column(0), batch.column(1)):
                members.append(gzip.compress(head.as_py().encode("utf-8", "surrogatepass") + (payload.as_py() or b"") + END, 6, mtime=0))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield full()
                    members, size = [], 0
        if members:
            yield full()

    return run


def records(content: bytes, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped archive of one or more members, unpacked step by step."""
    unzip, buffer, at = zlib.decompressobj(31), bytearray(), 0

    def more() -> bool:
        nonlocal unzip, at
        if at >= len(content):
            return False
        if unzip.eof:
            unzip = zlib.decompressobj(31)
        part = content[at : at + step]
        at += len(part)
        buffer.extend(unzip.decompress(part))
        at -= len(unzip.unused_data)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if buffer.strip():
                raise ValueError("an archive ends within a record's headers")
            return
        lines = buffer[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(headers["content-length"])
        while len(buffer) < end + 4 + size + 4 and more():
            pass
        if len(buffer) < end + 4 + size + 4:
            raise ValueError("an archive ends within a record")
        yield headers, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 8 + size]


FIELDS = {"page_id": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "refers_to_id": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}


def read(spark, path: str, html: bool = False) -> DataFrame:
    """page_id, record_type, record_id, refers_to_id, payload_bytes, payload_digest and, if asked for, html, of every record.

    Bytes and digest of a response are counted over the payload read, and must
    be what its headers say; a revisit's are in its headers.
    """
    kinds = FIELDS | ({"html": pa.string()} if html else {})
    schema = ", ".join(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in kinds.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for head, block in records(content.as_py()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    said = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if digest != said:
                            raise ValueError(f"payload of {head['warc-record-id']} is damaged")
                    else:
                        size, digest = int(head["x-payload-length"]), said
                    page = head.get("x-page-id")
                    rows.append((None if page is None else int(page), head["warc-type"], head["warc-record-id"], head.get("warc-refers-to"), size, digest, *([payload.decode("utf-8")] if html else [])))
                    if len(rows) >= 500:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """read() rows with refers_to: for a revisit the page_id of the response that its headers refer to, else null.

    A revisit whose response isn't there, or has another digest, is an error when its row is read.
    """
    origin = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("__page"), F.max("payload_digest").alias("__digest"))
    both = join_hot(found, origin, ["refers_to_id"], "left")
    lost = (F.col("record_type") == "revisit") & ~F.col("payload_digest").eqNullSafe(F.col("__digest"))
    page = F.when(lost, F.raise_error(F.concat(F.lit("no response for revisit "), F.col("record_id"))).cast("long")).when(F.col("record_type") == "revisit", F.col("__page"))
    return both.withColumn("refers_to", page).drop("__page", "__digest")


def archive(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per page, read the archives back and resolve the revisits; an empty table gives no row.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Null and empty
    html are empty payloads, null ids stay null, repeated rows are records each;
    of pages only the three named columns are read. Archives stay if a path is
    given; else they are in the shared folder and go once they are read.
    """
    spark = pages.sparkSession
    folder = path or new_path(spark, "warc")
    rows = decided(pages, page_id, url, html, least_bytes)
    write(rows, folder)
    found = cut(read(spark, folder), "records")
    if path is None:
        drop_path(spark, folder)
    return resolved(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
