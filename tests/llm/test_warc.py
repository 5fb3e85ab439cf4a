from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from conftest_llm import rows_of
from pyspark.sql import functions as F

from mergeloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages():
    long = "é漢 <p>text WARC/1.1\r\nWARC-Type: response\r\n\r\n</p> 🙂 " * 400
    rows = [(i, f"http://x/{i}", f"<p>{i % 5}</p>") for i in range(20)]
    rows += [(30, "http://x/\r\nbad", long), (29, None, long), (31, "u", long + "!"), (32, "u", None), (33, "u", ""), (None, "u", "<p>1</p>"), (None, None, "alone"), (40, "u", "\r\n0\r\n\r\n"), (3, "again", "<p>3</p>"), (29, None, long), (29, None, long)]
    return rows


def brute(rows, least=0):
    groups, out = {}, []
    for p, u, h in rows:
        groups.setdefault((h or "").encode(), []).append((p is None, p or 0, u is not None, u or ""))
    for data, own in groups.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for k, (no_page, page, *_) in enumerate(sorted(own)):
            again = k > 0 and len(data) >= least
            to = min(own)[1] if again and not min(own)[0] else None
            out.append((None if no_page else page, len(data), digest, "revisit" if again else "response", to))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("segment", "chunk", "least"), [(16 << 10, 4 << 10, 0), (100, 7, 0), (1000, 64, 10)])
def test_round_trip(spark, tmp_path, segment, chunk, least):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    odd = df.select("*", *[F.lit(1).alias(c) for c in ("payload", "digest", "id", "block", "n", "URL")])
    warc.write_archives(odd, f"{tmp_path}/w", segment, chunk, least)
    read = warc.read_archives(spark, f"{tmp_path}/w")
    assert rows_of(warc.digests(read)) == brute(pages(), least)
    texts = {bytes(r.payload).decode() for r in read.where("record_type = 'response'").collect()}
    assert texts == {h or "" for _, _, h in pages()}
    lean = warc.read_archives(spark, f"{tmp_path}/w", payloads=False)
    assert rows_of(warc.digests(lean)) == brute(pages(), least) and lean.where("payload is not null or error is not null").count() == 0


def test_files_are_warc(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA).coalesce(1), f"{tmp_path}/w", 500, 50)
    found = [r for p in Path(f"{tmp_path}/w").glob("*.gz") for r in warc.records(gzip.decompress(p.read_bytes()))]
    assert not any(e for *_, e in found)
    kinds = [f["warc-type"] for f, *_ in found]
    assert set(kinds) == {"warcinfo", "response", "continuation", "revisit"} and kinds.count("warcinfo") == 1
    assert len({f["warc-record-id"] for f, *_ in found}) == len(found)
    assert all(f["warc-segment-origin-id"] and int(f["warc-segment-number"]) > 1 for f, *_ in found if f["warc-type"] == "continuation")
    assert all(f["warc-refers-to"] and f["warc-profile"] == warc.REVISIT for f, *_ in found if f["warc-type"] == "revisit")


def test_a_very_long_page(spark, tmp_path):
    html = "".join(f"<p>{i} é</p>" for i in range(400_000))
    warc.write_archives(spark.createDataFrame([(1, "u", html), (2, "u", html)], SCHEMA), f"{tmp_path}/w")
    read = warc.read_archives(spark, f"{tmp_path}/w")
    assert rows_of(warc.digests(read)) == brute([(1, "u", html), (2, "u", html)])


def test_chunked_framing():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.body_of(head + b"3;x=y\r\nabc\r\n1\r\nd\r\n0\r\n\r\n") == b"abcd"
    assert warc.body_of(b"HTTP/1.1 200 OK\r\n\r\nabc") == b"abc"
    for bad in (b"3\r\nab\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.body_of(head + bad)


def record(kind="response", block=b"HTTP/1.1 200 OK\r\n\r\nbody", size=None, **fields):
    lines = {"WARC-Type": kind, "WARC-Record-ID": "<a>", "Content-Length": len(block) if size is None else size} | {k.replace("_", "-"): v for k, v in fields.items()}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_reading_goes_on_after_broken_records(spark, tmp_path):
    for bad in (b"junk\r\n", record(size=999_999), record(size=3), record(size="x"), b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"):
        found = list(warc.records(record(Page_ID=1) + bad + record(Page_ID=2)))
        pages = [f.get("page-id") for f, _, e in found if not e]
        assert pages == ["1", "2"] and sum(e is not None for *_, e in found) == 1, (bad, found)
    data = record(Page_ID=1) + record(Page_ID=2, block=b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nab\r\n0\r\n\r\n") + b"junk"
    (tmp_path / "plain.warc").write_bytes(data)
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(record(Page_ID=3)) + gzip.compress(record(Page_ID=4, kind="request")) + gzip.compress(record(Page_ID=5))[:-20])
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in rows if not r.error and r.page_id) == [1, 3]
    assert {r.page_id for r in rows if r.error} >= {2, None} and all(r.payload is None for r in rows if r.error)
    assert [bytes(r.payload) for r in rows if r.page_id == 1] == [b"body"]


def test_pieces_of_any_size():
    data = b"".join(record(Page_ID=i, block=b"x" * i) for i in range(50))
    for size in (1, 7, 100, 10**6):
        pieces = warc.unzipped(gzip.compress(data[:500]) + gzip.compress(data[500:]), size)
        assert [(f["page-id"], len(b), e) for f, b, e in warc.records(pieces)] == [(str(i), i, None) for i in range(50)]


def test_segments_that_do_not_fit_are_rows_with_an_error(spark):
    row = "origin string, segment int, block binary, total long, page_id long, url string, record_type string, refers_to string"
    for segments in ([1, 3], [1, 2], [2], [1, 1, 2]):  # one missing, a wrong total, no head, one twice with a wrong total
        df = spark.createDataFrame([("o", s, bytearray(b"ab"), 9 if s == segments[-1] else None, 1, "u", "response", None) for s in segments], row)
        found = warc.reassembled(df).first()
        assert "are stated" in found.error and found.payload is None and found.record_id == "o"
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    twice = [("o", 1, bytearray(block[:5]), None, 1, "u", "response", None)] * 2 + [("o", 2, bytearray(block[5:]), len(block), None, None, "continuation", None)] * 2
    assert bytes(warc.reassembled(spark.createDataFrame(twice, row)).first().payload) == b"abc"


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/w")
    assert rows_of(warc.digests(warc.read_archives(spark, f"{tmp_path}/w"))) == []
