"""Archives: exact round trips over ranges of any size, records at all borders, and a plain version of the copies."""

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from glyphward.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages(seed=1):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice("abcdé <p>\r\n") for _ in range(rnd.randrange(400))) for _ in range(60)]
    texts += [texts[0] + "x" * 100] * 9 + ["y" * 99] * 4 + ["y" * 100] * 4 + ["", None, None, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "é" * 50, "é" * 50]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [(i, None if i % 11 == 0 else f"http://h/{i}?q=a b\r\nX: 1", texts[k]) for i, k in enumerate(order)]


def plain(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(data) if first.get(data, i) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("range_bytes", [37, 200, 1000, None])
def test_round_trip(spark, range_bytes):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    records = warc.archived(df, range_bytes=range_bytes, payloads=True)
    assert found(records) == plain(rows)
    texts = {i: (html or "").encode() for i, _, html in rows}
    assert all(r.payload == (texts[r.page_id] if r.type == "response" else b"") for r in records.collect())


def test_ranges_own_each_record_once(tmp_path):
    """Every cut of an archive into two ranges, with stored members and the magic inside payloads."""
    rnd = random.Random(2)
    data, at = b"", []
    for i in range(12):
        payload = bytes(rnd.randrange(256) for _ in range(rnd.randrange(120))) + warc.MAGIC * (i % 3)
        at.append(len(data))
        data += warc.member(warc.record(i, "u", payload, hashlib.sha256(payload).hexdigest(), len(payload)))
    size = len(data)
    for cut in range(0, size, 3):
        got = [o[0] for a, b in ((0, cut), (cut, size)) for o in warc.owned(warc.Bytes(io.BytesIO(data), size), a, b, False)]
        assert got == at, cut


def test_archives_inside_payloads_are_no_records():
    """Members that are stored raw inside a payload fail where a range begins inside that payload."""
    inner = b"".join(warc.member(warc.record(k, "in", b"inner %d" % k, "0", 7)) for k in range(3))
    outer = warc.record(1, "out", inner, hashlib.sha256(inner).hexdigest(), len(inner))
    raw = io.BytesIO()
    with gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=0, mtime=0) as f:
        f.write(outer)
    data = raw.getvalue() + warc.member(warc.record(2, "next", b"n", "0", 1))
    places = [o[0] for o in warc.owned(warc.Bytes(io.BytesIO(data), len(data)), 0, len(data), False)]
    assert len(places) == 2
    begin = len(raw.getvalue()) - 200  # the last inner member is followed by the outer record's end
    assert [o[0] for o in warc.owned(warc.Bytes(io.BytesIO(data), len(data)), begin, len(data), False)] == places[1:]


def test_members_are_gzip_and_records_are_warc(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archive(spark.createDataFrame([(1, "http://x/é", "<p>" * 99)], SCHEMA), path)
    files = [f for f in (tmp_path / "a").iterdir() if f.name.startswith("part-") and f.stat().st_size]
    text = gzip.decompress(files[0].read_bytes())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"<p>\r\n\r\n") and "http://x/é".encode() in text
    records = warc.read_archive(spark, path, range_bytes=50)
    assert warc.untiled(records, path).count() == 0
    assert warc.untiled(records.filter("false"), path).count() == 1


def test_long_records_and_pieces(spark):
    """A record of over 16 MB, whose last byte is not zero, among others; memory is bounded by blocks."""
    rows = [(1, "a", "z" * 150), (2, "b", "long é" * 4_000_000), (3, None, "z" * 150), (4, "d", "q" * 17_000_000)]
    assert found(warc.archived(spark.createDataFrame(rows, SCHEMA).coalesce(1), range_bytes=3000)) == plain(rows)


def test_odd_rows(spark):
    """Null and repeated ids, copies with null ids only, ids as strings, clashing columns, an empty table."""
    rows = [(None, None, "n" * 200)] * 2 + [(5, "u", "m" * 200)] * 2 + [(6, "u", "m" * 200), (None, "u", "m" * 200), (7, None, None)]
    clash = {c: F.lit(1) for c in ("id", "payload", "digest", "length", "first_id", "n", "type", "file", "offset", "path", "start", "end")}
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(warc.archived(df.withColumns(clash))) == plain(rows)
    named = warc.archived(df.withColumn("page_id", F.concat(F.lit("p "), F.col("page_id").cast("string"))))
    assert {r.refers_to for r in named.collect()} == {None, "p 5"}
    assert warc.archived(df.filter("false")).count() == 0
