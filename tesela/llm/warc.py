"""WARC archives: writing records for pages, and reading them back with segments put together again.

Writing uses DataFrame functions alone. A payload becomes an HTTP response with chunked framing; a record block of over `SEGMENT` bytes is
cut into segments (a first record and continuation records that name it by WARC-Segment-Origin-ID). So no record is longer
than SEGMENT and its header, and a file of `FILE_RECORDS` records has a bound that page sizes do not move. Files are gzipped WARC.

Reading takes each file in one go and once, follows Content-Length from record to record, groups continuation records by their origin, orders
them by segment number, verifies the total length, decodes the chunked framing and compares the payload with the digest in its header. A
revisit names its response by WARC-Refers-To, which a join resolves. What is not well formed becomes a row that tells what is wrong.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch_path

CHUNK, SEGMENT, FILE_RECORDS = 4_096, 8_192, 2_000
#: Shorter payloads are never revisits.
LEAST_REVISIT = 100
_NEW = "\r\n"


def _lines(*parts: Column) -> Column:
    """Header lines; a null one is left out."""
    return F.concat_ws(_NEW, *parts)


def _named(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _chunked(payload: Column) -> Column:
    """The payload (binary) with chunked framing, as bytes in a string."""
    piece = lambda i: F.substring(payload, i * CHUNK + 1, F.lit(CHUNK))
    framed = lambda i: F.concat(F.lower(F.hex(F.octet_length(piece(i)).cast("long"))), F.lit(_NEW), piece(i).cast("string"), F.lit(_NEW))
    n = F.ceil(F.octet_length(payload) / CHUNK).cast("int")
    body = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), framed), "")).otherwise(F.lit(""))
    return F.concat(body, F.lit(f"0{_NEW}{_NEW}"))


def _urn(uuid: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def _record_id(key: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws(" ", key.cast("string"), digest), 256)
    return _urn(F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row `record` for each WARC record (without the blank lines that end it) of the pages.

    Null html is an empty payload. Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest key are responses (nulls among keys
    come after all others), the others revisits of it. A response's record id follows from its key and digest; where rows repeat both, each has an
    id of its own and names that one by WARC-Concurrent-To.
    """
    base = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha2("payload", 256))
    # counted by key first, so that what is dealt by digest is small; grouped by size too, so that the join deals both sides anew and a digest of many pages can be split
    counted = base.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size", "id").agg(F.count("*").alias("n"))
    first = counted.groupBy("digest", "size").agg(F.min("id").alias("first"), F.min_by("n", "id").alias("first_n"), F.sum("n").alias("copies")).filter("copies > 1").select("digest", "first", "first_n")
    base = base.join(first, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    again = F.col("id").isNull() | (F.col("first").isNotNull() & (F.col("id") == F.col("first")) & (F.col("first_n") > 1))
    base = base.withColumn("rid", F.when(again, _urn(F.expr("uuid()"))).otherwise(_record_id(F.col("id"), F.col("digest"))))
    base = base.withColumn("beside", F.when(again & F.col("id").isNotNull(), _record_id(F.col("id"), F.col("digest"))))
    target = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("-"))))
    http = F.when(F.col("revisit"), F.lit(f"HTTP/1.1 200 OK{_NEW}Content-Type: text/html; charset=utf-8{_NEW}{_NEW}")).otherwise(F.concat(F.lit(f"HTTP/1.1 200 OK{_NEW}Content-Type: text/html; charset=utf-8{_NEW}Transfer-Encoding: chunked{_NEW}{_NEW}"), _chunked(F.col("payload"))))
    base = base.select("id", "digest", "first", "revisit", "rid", "beside", target.alias("target"), http.cast("binary").alias("block")).withColumn("total", F.octet_length("block"))
    base = base.withColumn("parts", F.greatest(F.ceil(F.col("total") / SEGMENT).cast("int"), F.lit(1)))
    # the pieces are cut before the rows are, so that no row carries the whole block
    pieces = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: F.substring(F.col("block"), (i - 1) * SEGMENT + 1, F.lit(SEGMENT)))
    cut = base.withColumn("pieces", pieces).drop("block").select("*", F.posexplode("pieces").alias("at", "piece")).drop("pieces").withColumn("part", F.col("at") + 1)
    block = F.col("piece")
    begins, several, ends = F.col("part") == 1, F.col("parts") > 1, F.col("part") == F.col("parts")
    header = _lines(
        F.lit("WARC/1.1"),
        _named("WARC-Type", F.when(F.col("revisit"), "revisit").when(begins, "response").otherwise("continuation")),
        _named("WARC-Record-ID", F.when(begins, F.col("rid")).otherwise(_urn(F.expr("uuid()")))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        _named("WARC-Target-URI", F.col("target")),
        F.when(begins, _named("X-Page-ID", F.col("id"))),
        F.when(begins, _named("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("revisit"), _named("WARC-Refers-To", _record_id(F.col("first"), F.col("digest")))),
        F.when(begins, _named("WARC-Concurrent-To", F.col("beside"))),
        F.when(several, _named("WARC-Segment-Number", F.col("part"))),
        F.when(several & ~begins, _named("WARC-Segment-Origin-ID", F.col("rid"))),
        F.when(several & ends, _named("WARC-Segment-Total-Length", F.col("total"))),
        F.when(begins, F.lit("Content-Type: application/http; msgtype=response")),
        _named("Content-Length", F.octet_length(block)),
    )
    return cut.select(F.concat(header, F.lit(_NEW + _NEW), block.cast("string")).alias("record"))


def write_archives(rows: DataFrame, path: str) -> None:
    """The records as gzipped WARC files in a folder that all executors share."""
    rows.write.option("lineSep", _NEW + _NEW).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


# ---------------------------------------------------------------- reading

def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record. One that is not well formed gives ({"error": why}, b""), and reading goes on
    where the next line begins with WARC/."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        length = fields.get("content-length", "")
        start = end + 4
        after = start + int(length) if length.isdecimal() else -1
        why = None
        if not head[0].startswith("WARC/"):
            why = "no WARC record"
        elif after < 0:
            why = "a record without a length"
        elif after > len(data) or data[after : after + 4] not in (b"\r\n\r\n", b""):
            why = f"a record that does not end after its {length} bytes"
        elif "warc-type" not in fields or "warc-record-id" not in fields:
            why = "a record without a type or an id"
        if why:
            yield {"error": f"{why}, at byte {at}"}, b""
            further = data.find(b"\nWARC/", at + 1)
            at = further + 1 if further >= 0 else len(data)
        else:
            yield fields, data[start:after]
            at = after + 4


def unchunked(body: bytes) -> bytes:
    """The bytes that chunked framing holds; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def joined(segments: list[tuple[int, bytes]], total: int) -> bytes:
    """The block from (number, bytes) of its segments in any order; a repeated segment counts once. Raises where one is missing or the length is not total."""
    by = dict(segments)
    if sorted(by) != list(range(1, len(by) + 1)):
        raise ValueError(f"segments {sorted(by)} are not all")
    block = b"".join(by[i] for i in sorted(by))
    if len(block) != total:
        raise ValueError(f"{len(block)} bytes, not {total}")
    return block


#: A record or segment as it is read: of a whole record the payload's length and digest take the place of the block. Broken ones have an origin each.
_PIECE = "origin string, number int, total long, type string, page_id string, named string, refers string, payload_bytes long, digest string, block binary, error string"
_PIECE_NAMES = [x.split()[0] for x in _PIECE.split(", ")]
_PIECE_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_PAGE = "page_id string, record_type string, record_id string, refers string, payload_bytes long, payload_digest string, error string"
_PAGE_NAMES = [x.split()[0] for x in _PAGE.split(", ")]


def _payload(block: bytes, stated: str | None) -> tuple[int | None, str | None, str | None]:
    """(bytes, digest, what is wrong) of a response's payload."""
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, stated, f"chunked framing: {e}"
    digest = hashlib.sha256(payload).hexdigest()
    return len(payload), digest, f"payload {digest}, stated {stated}" if stated and stated != digest else None


def _piece(fields: dict[str, str], block: bytes) -> tuple | None:
    if "error" in fields:
        return uuid.uuid4().hex, None, None, "broken", None, None, None, None, None, None, fields["error"]
    kind, rid, number = fields["warc-type"], fields["warc-record-id"], fields.get("warc-segment-number")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    head = kind, fields.get("x-page-id"), fields.get("warc-concurrent-to") or rid, fields.get("warc-refers-to")
    if number:
        numbers = number, fields.get("warc-segment-total-length", "0")
        if not all(x.isdecimal() for x in numbers):
            return uuid.uuid4().hex, None, None, "broken", None, rid, None, None, None, None, f"segment {numbers[0]} of {numbers[1]} bytes"
        return fields.get("warc-segment-origin-id") or rid, int(number), int(numbers[1]), *head, None, stated, block, None
    if kind == "revisit":
        return rid, None, None, *head, None, stated, None, None
    if kind == "response":
        size, digest, wrong = _payload(block, stated)
        return rid, None, None, *head, size, digest, None, wrong
    return None


def _inflated(data: bytes) -> bytes:
    """The contents of a gzip file of one member or many, or of a plain file."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [_PIECE_KINDS[x.split()[1]] for x in _PIECE.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows = [r for r in (_piece(*x) for x in parse(_inflated(content.as_buffer().to_pybytes()))) if r]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_PIECE_NAMES)


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (origin, its pieces): each whole record, and the page that the segments make."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        out = []
        for pieces in batch.column(0).to_pylist():
            out += [(x["page_id"], x["type"], x["named"], x["refers"], x["payload_bytes"], x["digest"], x["error"]) for x in pieces if x["number"] is None]
            parts = [x for x in pieces if x["number"] is not None]
            if parts:
                head = min(parts, key=lambda x: x["number"])
                try:
                    block = joined([(x["number"], x["block"]) for x in parts], max(x["total"] for x in parts))
                except ValueError as e:
                    out.append((head["page_id"], "response", head["named"], None, None, head["digest"], str(e)))
                else:
                    out.append((head["page_id"], "response", head["named"], None, *_payload(block, head["digest"])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_PAGE_NAMES)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id (text), record_type, record_id (or that of the record it stands beside), refers (a record id), payload_bytes, payload_digest and
    error of every response and revisit in the archives of a folder.

    The pieces of a record meet in one task: a page is what bounds them. payload_bytes of a revisit is null here. A record that is not well formed
    gives a row of type `broken`, a page with a segment missing, of another length or of another digest than stated a response, both with an error.
    A segment that is there twice counts once.
    """
    pieces = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, _PIECE)
    met = pieces.groupBy("origin").agg(F.collect_list(F.struct(*_PIECE_NAMES[1:])).alias("pieces"))
    return met.select("pieces").mapInArrow(_reassembled, _PAGE)


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages to archives and reads them back: key, payload_bytes, payload_digest, record_type, refers_to for each row.

    A revisit's length and refers_to are those of the response that its WARC-Refers-To names. Rows that repeat the smallest key of a payload are
    responses all. Null keys stay, an empty table gives none, other columns are not used. Raises where the archives do not read back whole.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(records(pages, key, url, html), path)
    found = saved(read_pages(spark, path), "pages")
    wrong = found.filter("error is not null").limit(3).collect()
    if wrong:
        raise ValueError(f"archives that do not read back: {[r.error for r in wrong]}")
    kind = pages.schema[key].dataType
    responses = found.filter("record_type = 'response'")
    # grouped by length too, so that the join deals both sides anew and a response with many revisits can be split
    named = responses.groupBy(F.col("record_id").alias("refers"), F.col("payload_bytes").alias("of_response")).agg(F.min(F.col("page_id").cast(kind)).alias("named"))
    revisits = found.filter("record_type = 'revisit'").join(named, "refers", "left")
    revisits = revisits.select("page_id", F.col("of_response").alias("payload_bytes"), "payload_digest", "record_type", F.col("named").alias("refers_to"))
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to")).unionByName(revisits).withColumn("page_id", F.col("page_id").cast(kind)).withColumnRenamed("page_id", key).select(key, "payload_bytes", "payload_digest", "record_type", "refers_to")
