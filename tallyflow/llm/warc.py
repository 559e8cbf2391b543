"""WARC archives without repeated payloads: revisit resolution.

Headers (ids, digests, lengths) are shuffled by payload digest to find the record that stays the
response for each repeated payload. Payloads of ``SMALL`` bytes or more join that list, which holds
repeated digests only, and are written once; the other records become revisits of the response with
fresh headers. Reading back, revisits join the responses they refer to.

An archive is a folder of files of gzip members, one for each record, so that a reader can start at any
record. An empty member follows each of them; Spark's text reader splits files there, and a file of any
size is read by many tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import needed, ready, stored
from tallyflow.session import scratch_folder

#: Payloads below this many bytes are always written: a revisit record would not be smaller.
SMALL = 1000
#: An empty gzip member; it ends a record's member in the files written here.
END = bytes.fromhex("1f8b08000000000000030300" + "00" * 8)
#: Bytes of packed or unpacked records that a task hands over at once.
RUN_BYTES = 8 << 20
BREAK = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADER_SCHEMA = (
    "record_type string, record_id string, page_id long, uri string, date string, payload_bytes long, "
    "payload_digest string, refers_to_record string"
)
#: A record as it stands in an archive: ``http`` is the head of an HTTP block (null for other blocks, which
#: are all ``payload``), ``rest`` the header lines that are not written anew, ``head`` all header lines.
RECORD_SCHEMA = HEADER_SCHEMA + ", rest string, head binary, http binary, payload binary"

#: Header fields that are written anew for responses and revisits.
FRESH = {
    "warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest", "warc-profile", "warc-refers-to",
    "warc-refers-to-target-uri", "warc-refers-to-date", "warc-block-digest", "x-page-id", "content-type", "content-length",
}


def _record_id(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts]), F.lit(">"))


def _lines(*lines: Column | str | tuple) -> Column:
    """Header lines, each with its break; a (condition, line) is left out where the condition fails."""
    made = []
    for line in lines:
        text = F.concat(line[1], F.lit(BREAK)) if isinstance(line, tuple) else F.concat(
            F.lit(line) if isinstance(line, str) else line, F.lit(BREAK))
        made.append(F.when(line[0], text).otherwise("") if isinstance(line, tuple) else text)
    return F.concat(*made)


def _named(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), (F.lit(value) if isinstance(value, str) else value).cast("string"))


def page_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as records to be archived: record_id, page_id, uri, date, http, payload, digest, bytes, rest.

    A null payload is empty; control characters and blanks in a url become %20.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = needed(pages, ["page_id", "url", "html"]).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\p{Cntrl} ]", "%20").alias("uri"),
        F.lit(date).alias("date"),
        payload.cast("binary").alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    http = F.concat(_lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", _named("Content-Length", F.col("bytes"))),
                    F.lit(BREAK))
    return rows.select(
        _record_id(F.col("page_id"), F.col("uri"), F.col("digest")).alias("record_id"), "*",
        http.cast("binary").alias("http"), F.lit("").alias("rest"))


def repeated_payloads(records: DataFrame, small: int = SMALL) -> DataFrame:
    """Of each payload that occurs more than once: digest, keep_record, keep_page_id, keep_uri, keep_date, tied.

    The record with the largest page_id stays, of those the one with the largest uri, date and id; ``tied``
    tells that several rows are that record.
    """
    own = ["page_id", "uri", "date", "record_id"]
    headers = records.filter(F.col("bytes") >= small).groupBy("digest", *own).agg(F.count("*").alias("n"))
    best = F.max(F.struct(*own, "n")).alias("best")
    return headers.groupBy("digest").agg(best, F.sum("n").alias("n")).filter("n > 1").select(
        "digest", F.col("best.record_id").alias("keep_record"), F.col("best.page_id").alias("keep_page_id"),
        F.col("best.uri").alias("keep_uri"), F.col("best.date").alias("keep_date"), (F.col("best.n") > 1).alias("tied"))


def resolve(records: DataFrame, small: int = SMALL) -> DataFrame:
    """Records with record_type and, for revisits, refers_to_record, refers_to_uri and refers_to_date.

    Revisits have no payload. Of rows that repeat in full and are the record that stays, one is the
    response. Payloads below ``small`` bytes meet nothing.
    """
    known = stored(repeated_payloads(records, small), "repeated")
    own = ["record_id", "page_id", "uri", "date", "digest", "bytes", "rest", "http", "payload"]
    short = records.filter(F.col("bytes") < small).select(F.lit("response").alias("record_type"), *own, *[
        F.lit(None).cast("string").alias(f"refers_to_{c}") for c in ("record", "uri", "date")])
    joined = records.filter(F.col("bytes") >= small).select(*own).join(known, "digest", "left")
    best = F.col("record_id") == F.col("keep_record")
    several = F.coalesce(best & F.col("tied"), F.lit(False))
    # rows that are the same record: one keeps the payload
    keys = ["digest", "record_id", "page_id", "uri", "date", "bytes", "keep_record", "keep_uri", "keep_date"]
    ties = joined.filter(several).groupBy(*keys).agg(
        F.first("payload").alias("payload"), F.first("http").alias("http"), F.first("rest").alias("rest"), F.count("*").alias("n"))
    ties = ties.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    rows = joined.filter(~several).withColumn("copy", F.lit(1)).select(*ties.drop("n").columns).unionByName(ties.drop("n"))
    revisit = F.col("keep_record").isNotNull() & ~(best & (F.col("copy") == 1))
    made = {
        "record_id": F.when(F.col("copy") == 1, F.col("record_id")).otherwise(_record_id(F.col("record_id"), F.col("copy"))),
        "payload": F.when(~revisit, F.col("payload")),
    }
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        *[made.get(c, F.col(c)).alias(c) for c in own],
        *[F.when(revisit, F.col(f"keep_{c}")).alias(f"refers_to_{c}") for c in ("record", "uri", "date")]).unionByName(short)


def with_headers(records: DataFrame) -> DataFrame:
    """Resolved records as they are written: head (binary, made anew), http, payload."""
    revisit = F.col("record_type") == "revisit"
    block_bytes = F.octet_length("http") + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    head = _lines(
        "WARC/1.1",
        _named("WARC-Type", F.col("record_type")),
        _named("WARC-Record-ID", F.col("record_id")),
        (F.col("date").isNotNull(), _named("WARC-Date", F.coalesce("date", F.lit("")))),
        (F.col("uri").isNotNull(), _named("WARC-Target-URI", F.coalesce("uri", F.lit("")))),
        _named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        (revisit, _named("WARC-Profile", REVISIT_PROFILE)),
        (revisit, _named("WARC-Refers-To", F.coalesce("refers_to_record", F.lit("")))),
        (revisit & F.col("refers_to_uri").isNotNull(), _named("WARC-Refers-To-Target-URI", F.coalesce("refers_to_uri", F.lit("")))),
        (revisit & F.col("refers_to_date").isNotNull(), _named("WARC-Refers-To-Date", F.coalesce("refers_to_date", F.lit("")))),
        (F.col("page_id").isNotNull(), _named("X-Page-ID", F.coalesce("page_id", F.lit(0)))),
        "Content-Type: application/http; msgtype=response",
        _named("Content-Length", block_bytes),
    )
    return records.select(F.concat(head, "rest").cast("binary").alias("head"), "http", "payload")


def member(*parts: bytes | pa.Buffer) -> bytes:
    """The parts as one gzip member in which ``END`` doesn't occur.

    Bytes that can't be made smaller are stored as they are, and may hold an ``END`` of their own; codes of
    other lengths shift them out of its pattern.
    """
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FIXED, zlib.Z_HUFFMAN_ONLY, zlib.Z_RLE):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31, 8, strategy)
        packed = b"".join([*(packer.compress(p) for p in parts), packer.flush()])
        if END not in packed:
            return packed
    raise ValueError("a record holds the end mark in every packing")


def _in_runs(rows: Iterator[tuple], schema: pa.Schema, width: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += width(row)
        if size >= RUN_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _write(rows: DataFrame, path: str) -> None:
    """Rows of head, http and payload (null: nothing) to files of gzip members."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> Iterator[tuple]:
            for batch in batches:
                for cells in zip(*batch.columns, strict=True):
                    head, http, payload = (c.as_buffer() if c.is_valid else b"" for c in cells)
                    yield (member(head, b"\r\n", http, payload, b"\r\n\r\n"),)

        return _in_runs(packed(), pa.schema([("member", pa.binary())]), lambda row: len(row[0]))

    members = rows.select("head", "http", "payload").mapInArrow(run, "member binary")
    # the text writer puts the bytes of a string down as they are
    (members.select(F.col("member").cast("string").alias("value")).write
     .option("encoding", "ISO-8859-1").option("lineSep", END.decode("latin-1")).text(path))


def write_archive(records: DataFrame, path: str) -> None:
    """Write resolved records as WARC/1.1 files of gzip members, one a record; every header is made anew.

    The text writer names the files ``.txt``; under ``.warc.gz`` other programs read them, and ``read_archive``
    as well.
    """
    _write(with_headers(records), path)


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in lines if b":" in line)
    return {name.decode("utf-8", "replace").strip().lower(): value.decode("utf-8", "replace").strip() for name, value in pairs}


def blocks(content: bytes) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(header lines, header fields, block) of each record of gzip members, by their lengths.

    The members are unpacked bit by bit: what is held is the record at hand.
    """
    unzip, packed, at, held = zlib.decompressobj(31), memoryview(content), 0, bytearray()

    def fill(size: int) -> bool:
        nonlocal at, unzip
        while len(held) < size:
            if unzip.eof:  # further members of the same file
                rest = unzip.unused_data or bytes(packed[at : at + (1 << 16)])
                at += 0 if unzip.unused_data else len(rest)
                if not rest:
                    return False
                unzip, data = zlib.decompressobj(31), rest
            elif at < len(packed):
                data = bytes(packed[at : at + (1 << 16)])
                at += len(data)
            else:
                return False
            held.extend(unzip.decompress(data))
        return True

    while fill(1):
        size = 1 << 12
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(size):
                raise ValueError("an archive ends within a header")
            size *= 2
        lines = bytes(held[: end + 2])
        if not lines.startswith(b"WARC/1."):
            raise ValueError(f"no record starts with {lines[:40]!r}")
        head = _fields(lines.split(b"\r\n")[1:])
        length = int(head["content-length"])
        fill(end + 4 + length + 4)
        block = bytes(held[end + 4 : end + 4 + length])
        if len(block) < length:
            raise ValueError("an archive ends within a record")
        del held[: end + 4 + length + 4]
        yield lines, head, block


def _parted(head: dict[str, str], block: bytes) -> tuple[bytes | None, bytes]:
    """The HTTP head of a block, with the blank line that ends it, and the payload; no head for other blocks."""
    kind = head.get("content-type", "application/http")
    if head.get("warc-type") not in ("response", "revisit", "request") or not kind.startswith("application/http"):
        return None, block
    http, mark, payload = block.partition(b"\r\n\r\n")
    return http + mark, payload


def parse(content: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(record headers, HTTP headers, payload) of each record of a gzipped archive file."""
    for _, head, block in blocks(content):
        http, payload = _parted(head, block)
        yield head, _fields((http or b"").split(b"\r\n")[1:]), payload


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def read_records(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, of any type, in the columns of ``RECORD_SCHEMA``.

    Without ``contents`` only those of ``HEADER_SCHEMA``. Digest and length of a response are those of the payload
    read, of other records those they state (null if they state none). Files written here are read
    by byte ranges; other programs' ``.gz`` files, of which each is read by one task, may hold 2 GB.
    """
    ready(spark)
    names = [c.split()[0] for c in (RECORD_SCHEMA if contents else HEADER_SCHEMA).split(", ")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "head": pa.binary(), "http": pa.binary(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def row(lines: bytes, head: dict[str, str], block: bytes) -> tuple:
        http, payload = _parted(head, block)
        response = head.get("warc-type") == "response"
        stated = head.get("warc-payload-digest")
        length = _whole(_fields((http or b"").split(b"\r\n")[1:]).get("content-length"))
        found = (
            head.get("warc-type"), head.get("warc-record-id"), _whole(head.get("x-page-id")), head.get("warc-target-uri"),
            head.get("warc-date"), len(payload) if response else length,
            hashlib.sha1(payload).hexdigest() if response else stated and stated.removeprefix("sha1:"),
            head.get("warc-refers-to"))
        if not contents:
            return found
        rest = b"".join(line + b"\r\n" for line in lines.split(b"\r\n")[1:-1]
                        if line.split(b":")[0].decode("utf-8", "replace").strip().lower() not in FRESH)
        return (*found, rest.decode("utf-8", "replace"), lines, http, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row(*record) for batch in batches for cell in batch.column(0) for record in blocks(cell.as_buffer()))
        return _in_runs(rows, schema, lambda r: len(r[-1] or b"") + 200 if contents else 200)

    own = (spark.read.option("encoding", "ISO-8859-1").option("lineSep", END.decode("latin-1"))
           .option("pathGlobFilter", "*.txt").schema("value string").text(path))
    others = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    members = own.select(F.col("value").cast("binary").alias("content")).unionByName(others.select("content"))
    return members.mapInArrow(run, RECORD_SCHEMA if contents else HEADER_SCHEMA)


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives below ``path``, with ``payload`` as text if asked for.

    Columns as in ``read_records``; a payload is read as UTF-8, null for revisits.
    """
    names = [c.split()[0] for c in HEADER_SCHEMA.split(", ")]
    if not payloads:
        return read_records(spark, path, contents=False)
    text = F.when(F.col("record_type") != "revisit", F.col("payload").cast("string")).alias("payload")
    return read_records(spark, path).select(*names, text)


def resolved_headers(headers: DataFrame) -> DataFrame:
    """Header rows with ``refers_to``: the page_id of the response that a revisit refers to, else null."""
    responses = headers.filter("record_type = 'response'")
    targets = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    revisits = headers.filter("record_type <> 'response'").join(
        targets.groupBy("refers_to_record").agg(F.max("refers_to").alias("refers_to")), "refers_to_record", "left")
    return revisits.select(*headers.columns, "refers_to").unionByName(
        responses.withColumn("refers_to", F.lit(None).cast("long")))


def rewrite_archive(spark: SparkSession, source: str, target: str, small: int = SMALL) -> None:
    """Archives with repeated payloads at ``source`` to archives without at ``target``.

    Responses with an HTTP block are resolved by their payloads, bytes as they are; status, HTTP headers, date,
    id and further header lines of a record stay. Revisits refer to the response that their payload has now.
    Records of other types, and revisits whose response is not at ``source``, pass unchanged.
    """
    rows = stored(read_records(spark, source), "records").withColumnsRenamed({"payload_digest": "digest", "payload_bytes": "bytes"})
    web = F.col("http").isNotNull() & F.col("record_id").isNotNull() & F.col("record_type").isNotNull()
    response = F.coalesce(web & (F.col("record_type") == "response"), F.lit(False))
    resolved = stored(resolve(rows.filter(response), small), "resolved")
    # where a response's payload stands now: with itself, or with the record that it refers to
    now = F.struct(*[F.coalesce(f"refers_to_{a}", b).alias(a) for a, b in (("record", "record_id"), ("uri", "uri"), ("date", "date"))],
                   "digest", "bytes")
    places = resolved.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min(now).alias("now"))
    revisit = F.coalesce(web & (F.col("record_type") == "revisit"), F.lit(False))
    revisits = rows.filter(revisit).join(places, "refers_to_record", "left")
    pointed = revisits.filter("now IS NOT NULL").select(
        "record_type", "record_id", "page_id", "uri", "date", "now.digest", "now.bytes", "rest", "http",
        F.lit(None).cast("binary").alias("payload"),
        *[F.col(f"now.{c}").alias(f"refers_to_{c}") for c in ("record", "uri", "date")])
    parts = ["head", "http", "payload"]
    through = rows.filter(~response & ~revisit).select(*parts).unionByName(revisits.filter("now IS NULL").select(*parts))
    _write(with_headers(resolved.unionByName(pointed)).unionByName(through), target)


def archive_pages(pages: DataFrame, path: str | None = None, small: int = SMALL) -> DataFrame:
    """Write pages as archives without repeated payloads, read them back and report each record.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Of records with
    equal payloads of at least ``small`` bytes the largest page_id is the response (a null page_id is
    smaller than any other) and the others revisit it. A null html is an empty payload. No pages give
    no rows; further columns are ignored.
    """
    spark = ready(pages.sparkSession)
    path = path or scratch_folder(spark, "warc")
    write_archive(resolve(page_records(pages), small), path)
    headers = stored(read_archive(spark, path), "headers")
    return resolved_headers(headers).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
