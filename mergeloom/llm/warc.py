"""WARC archives: writing, and reading back with segment reassembly.

Writing. A page is an HTTP response whose body is framed in chunks. A block
longer than ``SEGMENT`` bytes is cut: the first part is the ``response`` record
with segment number 1, the others are ``continuation`` records that name it as
their origin; the last one carries the total length. Of pages with equal
payloads of at least ``least`` bytes the one with the smallest page_id is the
response, the others are ``revisit`` records that refer to it; smaller payloads
are all responses. Payloads travel once, to where one of each is chosen, and
copies of a task's own pages not at all; revisits are made from ids and digests
alone, added up by page before they meet their response. Records are built by
native expressions and written by Spark's text writer (gzip), so an archive
appears by task commit and survives lost executors. No record is longer than a
segment and its header, so the number of records bounds a file: about
``FILE_BYTES`` before compression by the mean record, ``MOST_FILE_BYTES`` at most.

Reading. Each file is unzipped and parsed as a stream, record by record, from
gzip files of one or many members or plain ones. Records without continuations
are decoded where they are read; their length and digest are measured there, so
a reader that needs no more asks for no payloads. The others are grouped by
origin id, once: segments in order, checked to be gapless and of the stated
total length, and the chunked framing taken off. An origin's segments are as
many as its own length asks for, however many copies the page has. A record
that is broken, or segments that do not fit, give a row with ``error`` and no
payload, and reading goes on with the next record.

Null html counts as an empty payload. Null page_ids come after all others.
Rows with the smallest page_id of a payload that come several times give one
response, the smallest url's, and revisits. Line breaks in urls become spaces,
null urls ``urn:page:`` and the id. Very long pages are held whole by the task
that decodes them, one at a time. Other columns, whatever their names, are not
read. An empty table writes an archive of its info record only, and reading
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm.common import materialize, pick
from mergeloom.session import ship

SEGMENT = 16 << 10
CHUNK = 4 << 10
FILE_BYTES, MOST_FILE_BYTES = 32 << 20, 256 << 20
HEADER_BYTES = 1 << 10  # of a record, about
LONGEST_HEADER = 4 << 20  # that a reader accepts
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INFO = "software: mergeloom\r\nformat: WARC File Format 1.1\r\n"
HEAD = "record_id string, page_id long, url string, record_type string, refers_to string"
FOUND = "payload binary, payload_bytes long, payload_digest string, error string"
RECORDS = f"{HEAD}, origin string, segment int, total long, block binary, {FOUND}"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of 20 bits, four digits each."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _chunked(payload: Column, size: int) -> Column:
    """The payload in chunked framing, as a string of the same bytes."""
    at = F.sequence(F.lit(0), F.greatest(F.octet_length(payload) - 1, F.lit(0)), F.lit(size))
    part = lambda i: F.substring(payload, i + 1, F.lit(size))
    chunk = lambda i: F.concat(F.lower(F.hex(F.octet_length(part(i)).cast("long"))), F.lit("\r\n"), part(i).cast("string"), F.lit("\r\n"))
    body = F.when(F.octet_length(payload) > 0, F.array_join(F.transform(at, chunk), "")).otherwise("")
    return F.concat(F.lit(HTTP), body, F.lit("0\r\n\r\n"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record but for its last line break, which the writer adds."""
    lines = [F.lit("WARC/1.1\r\n")]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in fields]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block.cast("string"), F.lit("\r\n"))


def _chosen(rows: DataFrame, *values: str) -> DataFrame:
    """(digest, r): of the rows of a digest that with the smallest page_id."""
    order = F.struct(F.col("page_id").isNull(), "page_id", "url")
    return rows.groupBy("digest").agg(F.min_by(F.struct("page_id", "url", *values), order).alias("r"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, least: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files in ``path``."""
    spark: SparkSession = pages.sparkSession
    pages = pick(pages, page_id="long", url="string", html="string")
    pages = pages.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).drop("html").withColumn("digest", base32_sha1(F.col("payload")))
    shared = F.octet_length("payload") >= least
    counted = pages.groupBy("digest", "page_id", "url", shared.alias("shared")).agg(F.count("*").alias("n"), F.sum(F.octet_length("payload").cast("long") + HEADER_BYTES).alias("bytes"))
    counted = materialize(counted, "counted")
    rows, size = counted.agg(F.sum("n"), F.sum("bytes")).first()
    each = max(16, min(FILE_BYTES * (rows or 1) // (size or 1), MOST_FILE_BYTES // (segment + HEADER_BYTES)))
    response = _chosen(pages.where(shared), "payload").select("digest", "r.*", F.lit(None).cast("long").alias("row"))
    response = response.unionByName(pages.where(~shared).withColumn("row", F.monotonically_increasing_id()))
    block = _chunked(F.col("payload"), chunk).cast("binary")
    response = response.select("page_id", "url", "digest", F.lit(True).alias("answers"), _urn(F.col("digest"), F.col("row"), F.lit("response")).alias("id"), block.alias("block"))
    own = _chosen(counted.where("shared")).select("digest", F.col("r.page_id").alias("page_id"), F.col("r.url").alias("url"), F.lit(1).alias("first"))
    keys = lambda df: [F.col("digest"), F.col("page_id").isNull().alias("_no_page"), F.coalesce("page_id", F.lit(0)).alias("_page"), F.col("url").isNull().alias("_no_url"), F.coalesce("url", F.lit("")).alias("_url")]
    joined = counted.where("shared").select("page_id", "url", "n", *keys(counted)).join(own.select(*keys(own), "first"), ["digest", "_no_page", "_page", "_no_url", "_url"], "left")
    copies = joined.withColumn("n", F.col("n") - F.coalesce("first", F.lit(0))).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    revisit = copies.select("page_id", "url", "digest", F.lit(False).alias("answers"), _urn(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"), F.lit("revisit")).alias("id"), F.encode(F.lit(HTTP), "UTF-8").alias("block"))
    uri = F.coalesce(F.regexp_replace("url", "[\r\n]", " "), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    cut = response.unionByName(revisit).withColumn("uri", uri)
    cut = cut.withColumn("n", F.greatest(F.ceil(F.octet_length("block") / F.lit(segment)), F.lit(1)).cast("int"))
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    piece = F.when(F.col("n") == 1, F.col("block")).otherwise(F.substring("block", (F.col("k") - 1) * segment + 1, F.lit(segment)))
    k, n, answers = F.col("k"), F.col("n"), F.col("answers")
    fields = [
        ("WARC-Type", F.when(k > 1, "continuation").when(answers, "response").otherwise("revisit")),
        ("WARC-Record-ID", F.when(k > 1, _urn(F.col("id"), k)).otherwise(F.col("id"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("uri")),
        ("Page-ID", F.col("page_id")),
        ("Content-Type", F.when(k == 1, "application/http;msgtype=response")),
        ("WARC-Payload-Digest", F.when(k == 1, F.concat(F.lit("sha1:"), F.col("digest")))),
        ("WARC-Profile", F.when(~answers, REVISIT)),
        ("WARC-Refers-To", F.when(~answers, _urn(F.col("digest"), F.lit(None), F.lit("response")))),
        ("WARC-Segment-Number", F.when(n > 1, k)),
        ("WARC-Segment-Origin-ID", F.when(k > 1, F.col("id"))),
        ("WARC-Segment-Total-Length", F.when((n > 1) & (k == n), F.octet_length("block"))),
    ]
    out = cut.withColumn("piece", piece).select(_record(fields, F.col("piece")).alias("value"))
    info = [("WARC-Type", F.lit("warcinfo")), ("WARC-Record-ID", _urn(F.lit(path), F.lit("info"))), ("WARC-Date", F.lit(DATE)), ("Content-Type", F.lit("application/warc-fields"))]
    out = spark.range(0, 1, 1, 1).select(_record(info, F.lit(INFO)).alias("value")).union(out)
    out.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", each).text(path)


def unzipped(data: memoryview | bytes, most: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, or of a plain file,
    in pieces of at most ``most``."""
    data = memoryview(data)
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[i : i + most]) for i in range(0, len(data), most))
        return
    at, inner = 0, zlib.decompressobj(31)
    rest = b""
    while at < len(data) or rest:
        if not rest:
            rest, at = bytes(data[at : at + most]), at + most
        if inner.eof:
            inner = zlib.decompressobj(31)
        if out := inner.decompress(rest, most):
            yield out
        rest = inner.unused_data if inner.eof else inner.unconsumed_tail


class _Source:
    """A stream of bytes with a look ahead: ``held[at:]``."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        self.pieces, self.held, self.at, self.error = iter(pieces), b"", 0, None

    def more(self) -> bool:
        try:
            piece = next(self.pieces, None)
        except zlib.error as e:
            piece, self.error = None, str(e)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def find(self, what: bytes, most: int) -> int:
        """The place of ``what`` from ``at``, within ``most`` bytes, or -1."""
        seen = 0
        while True:
            i = self.held.find(what, self.at + max(0, seen - len(what)))
            if i >= 0:
                return i - self.at
            seen = len(self.held) - self.at
            if seen > most or not self.more():
                return -1

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or fewer at the end."""
        parts, need = [], n
        while need > len(self.held) - self.at:
            parts.append(self.held[self.at :])
            need -= len(parts[-1])
            self.at = len(self.held)
            if not self.more():
                return b"".join(parts)
        parts.append(self.held[self.at : self.at + need])
        self.at += need
        return b"".join(parts)


def records(source: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(header fields by lower-case name, block, None) of each record. For what
    is no record: (what is known, b"", what is wrong), then the next record."""
    s = _Source([source] if isinstance(source, bytes) else source)
    while s.at < len(s.held) or s.more():
        end = s.find(b"\r\n\r\n", LONGEST_HEADER)
        if end >= 0 and s.held.startswith(b"WARC/", s.at):
            lines = s.take(end + 4)[:-4].decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = fields.get("content-length", "")
            if size.isascii() and size.isdigit():
                block, tail = s.take(int(size)), s.take(4)
                if len(block) == int(size) and tail == b"\r\n\r\n":
                    yield fields, block, None
                    continue
                yield fields, b"", "the record is not as long as it says"
                s.held, s.at = (block + tail + s.held[s.at :]), 0  # the next record may have begun in it
            else:
                yield fields, b"", "the record does not say how long it is"
        else:
            yield {}, b"", "no WARC record where one should begin"
            s.at = min(s.at + 1, len(s.held))
        while (i := s.find(b"\nWARC/", 0)) < 0:
            s.at = max(s.at, len(s.held) - 5)
            if not s.more():
                break
        s.at = s.at + i + 1 if i >= 0 else len(s.held)
    if s.error:
        yield {}, b"", s.error


def body_of(block: bytes) -> bytes:
    """The payload of an HTTP response, its chunked framing taken off."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("an HTTP response without the end of its header")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        digits = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("a chunk does not say how long it is")
        size = int(digits, 16)
        at = line + 2
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        at += size + 2


def _measured(block: bytes, payloads: bool) -> tuple:
    """FOUND of a response's whole block."""
    try:
        body = body_of(block)
    except ValueError as e:
        return None, None, None, str(e)
    return body if payloads else None, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), None


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isascii() and text.isdigit() else None


def _row(fields: dict[str, str], block: bytes, error: str | None, payloads: bool) -> tuple | None:
    """RECORDS of a response, revisit or continuation, or of an error."""
    kind, own, page = fields.get("warc-type"), fields.get("warc-record-id"), fields.get("page-id")
    page_id = int(page) if page and page.lstrip("-").isdigit() else None
    head = (own, page_id, fields.get("warc-target-uri"), kind, fields.get("warc-refers-to"))
    if error:
        return (*head, None, None, None, None, None, None, None, error)
    if kind not in ("response", "revisit", "continuation"):
        return None
    number = _number(fields.get("warc-segment-number"))
    if number is None:
        found = _measured(block, payloads) if kind == "response" else (None, None, None, None)
        return (*head, None, None, None, None, *found)
    return (*head, fields.get("warc-segment-origin-id", own), number, _number(fields.get("warc-segment-total-length")), block, None, None, None, None)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in text.split(", "))])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record_id, page_id, url, record_type, refers_to, payload, payload_bytes,
    payload_digest, error), a row for each response and each revisit (its payload
    columns null), and for each error. Without ``payloads`` that column is null."""
    ship(spark)

    def parse(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(RECORDS)
        for b in rows:
            for content in b.column(0):
                held, size = [], 0
                for fields, block, error in records(unzipped(content.as_buffer())):
                    if (row := _row(fields, block, error, payloads)) is None:
                        continue
                    held.append(row)
                    size += len(block) + HEADER_BYTES
                    if size > 4 << 20:
                        yield _batch(held, schema)
                        held, size = [], 0
                if held:
                    yield _batch(held, schema)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content").mapInArrow(parse, RECORDS)
    found = materialize(found, "records")
    columns = [x.split()[0] for x in f"{HEAD}, {FOUND}".split(", ")]
    whole = found.where("origin is null").select(*columns)
    return whole.unionByName(reassembled(found.where("origin is not null"), payloads).select(*columns))


def reassembled(segments: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each origin with its payload, or with what is wrong."""
    parts = segments.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "total", "page_id", "url", "record_type", "refers_to", "block"))).alias("parts"))

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(f"{HEAD}, {FOUND}")
        for b in rows:
            for i in range(b.num_rows):
                origin, own = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                yield _batch([_joined(origin, own, payloads)], schema)

    return parts.mapInArrow(decode, f"{HEAD}, {FOUND}")


def _joined(origin: str, parts: list[dict], payloads: bool) -> tuple:
    """HEAD and FOUND of the segments of one origin, in order; a segment that
    was read twice counts once."""
    once = [p for i, p in enumerate(parts) if not i or (p["segment"], p["block"]) != (parts[i - 1]["segment"], parts[i - 1]["block"])]
    block, totals = b"".join(p["block"] for p in once), {p["total"] for p in once if p["total"] is not None}
    first = once[0]
    kind = first["record_type"] if first["segment"] == 1 else "response"
    head = (origin, first["page_id"], first["url"], kind, first["refers_to"])
    if [p["segment"] for p in once] != list(range(1, len(once) + 1)) or totals != {len(block)}:
        return (*head, None, None, None, f"{len(once)} segments of {len(block)} bytes, {sorted(totals)} are stated")
    return (*head, *_measured(block, payloads))


def digests(read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of what
    ``read_archives`` gives; refers_to is the response's page_id. Payload columns
    are null for errors and for revisits of what is not there."""
    own = read.select("record_id", "page_id", "record_type", F.col("refers_to").alias("to"), "payload_bytes", "payload_digest")
    own = materialize(own, "digests")
    answers = own.where("record_type <=> 'response'")
    target = answers.groupBy(F.col("record_id").alias("to")).agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    target = materialize(target, "targets")  # so that a join on a payload that many share can be split
    again = own.where("not record_type <=> 'response'").select("page_id", "record_type", "to").join(target, "to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return answers.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(again.select(*columns))


def oracle_sql() -> str:
    groups = " || ".join(f"to_base(('0x' || substr(h, {1 + 5 * i}, 5))::bigint, 32, 4)" for i in range(8))
    return f"""
        with p as (select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
        q as (select page_id, strlen(html)::bigint as payload_bytes, translate({groups}, '{DIGITS}', '{BASE32}') as payload_digest,
            min(page_id) over (partition by html) as first, row_number() over (partition by html order by page_id nulls last, url) as k from p)
        select page_id, payload_bytes, payload_digest, case when k = 1 then 'response' else 'revisit' end as record_type,
            case when k > 1 then first end as refers_to from q"""
