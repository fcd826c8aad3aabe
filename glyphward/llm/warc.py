"""WARC archives: a writer, and a splittable reader of gzipped records.

Writing: each task turns its rows into records, one gzip member each, and Spark's text writer puts the members one after
the other, so a task that is run again or twice commits its file once and any file system of Spark's serves. The writer
ends a value with its separator, one zero byte: a member's last byte is zero anyway (its size's highest byte, below
16 MB), so it is left to the separator; a longer record is followed by an empty member, which readers pass over.

Reading: files are cut into byte ranges, a row each, and dealt to tasks. A task looks for the gzip magic inside its
range, decodes the beginning of each candidate and takes it as a record if a WARC header comes out; chance finds inside
compressed bytes fail there. It owns the records that start inside its range and reads on behind the range's end to
finish the last one. Behind a record the search goes on at the record's end, so its bytes are not searched. Where a range
begins inside a record, a candidate may also be a member that is stored inside that record's payload; so the first
candidate of a range counts only if it is whole and another record, or the end of the file, follows it. Records are
decoded piece by piece: of a payload only its length and digest are held, unless it is asked for.
:func:`untiled` tells files whose records do not cover them without a gap or overlap.

Copies: pages with equal payloads of ``least`` bytes or more are found by digest. Digests are counted with partial sums,
and only those of several pages are kept in a written table, so the planner broadcasts it where its true size is
below the session's bound and else sorts and merges (AQE splits a hot digest). Of copies the page with the smallest id
is a response, the others are revisits without a payload, which carry its length and digest in their headers.

Edge cases: null html is an empty payload; an empty payload is a response; rows with the smallest id of their group are
responses, all of them; a null id is larger than any other, and copies that all have null ids are responses; a null url
is left out; control characters and blanks in a url are percent-encoded; ids of any type are read back as that type; an empty table
gives an empty result; further columns are ignored. Payloads are below 2 GB, as Spark's values are.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.remote import file_system
from .shared import _delete, cleaned_up, shared_dir, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always responses.
LEAST_BYTES = 100
#: Bytes read at a time; bytes of a record's header at most; results that a task holds before it passes them on.
BLOCK, HEADER_BYTES, FLUSH_BYTES = 1 << 18, 1 << 16, 4 << 20
#: Names records, together with the page's id and the payload's digest.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:glyphward:page")
RECORD = "file string, offset bigint, bytes bigint, type string, page_id string, url string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


# Writing


def _line(name: str, value) -> bytes:
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))
    return f"{name}: {safe}\r\n".encode()


def _name(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, length: int, first_id=None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A record as WARC has it. With ``first_id`` it is a revisit, and the payload is left out."""
    revisit = first_id is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    head = [VERSION, _line("WARC-Type", "revisit" if revisit else "response"), _line("WARC-Record-ID", _name(page_id, digest)), _line("WARC-Date", date)]
    if url is not None:
        head.append(_line("WARC-Target-URI", url))
    head += [_line("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        head.append(_line("Page-ID", quote(str(page_id))))
    if revisit:
        head += [_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", _name(first_id, digest)), _line("Refers-To-Page-ID", quote(str(first_id)))]
        payload = b""
    head += [b"Content-Type: application/http;msgtype=response\r\n", _line("Content-Length", len(http) + len(payload)), b"\r\n"]
    return b"".join([*head, http, payload, b"\r\n\r\n"])


def member(data: bytes) -> bytes:
    """``data`` as one gzip member with no name and no time; a zero byte ends it."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = squeeze.compress(data) + squeeze.flush()
    return out if out[-1] == 0 else out + member(b"")


#: What follows a record whose last byte is not zero.
EMPTY = member(b"")


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, url, payload, digest, length, first id) to members without their last byte."""
    for batch in batches:
        held, size = [], 0
        for i in range(batch.num_rows):
            page_id, url, payload, digest, length, first_id = (c[i].as_py() for c in batch.columns)
            held.append(member(record(page_id, url, payload or b"", digest, length, first_id))[:-1])
            size += len(held[-1])
            if size >= FLUSH_BYTES or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["member"])
                held, size = [], 0


def with_copies(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(id, url, payload, digest, length, first_id): ``first_id`` is the smallest id of the same payload where that is
    another page's, else null."""
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "length": F.length("payload").cast("long")})
    copied = rows.filter(F.col("length") >= least).groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first_id IS NOT NULL")
    copied = written(copied.select("digest", "first_id"), "copied-pages")
    joined = rows.join(copied, "digest", "left")
    first = F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("id", "url", F.when(first.isNull(), F.col("payload")).alias("payload"), "digest", "length", first.alias("first_id"))


def write_archive(pages: DataFrame, path: str, **columns) -> None:
    """Writes ``pages`` below ``path`` as ``.warc.gz`` members, in as many files as there are tasks."""
    rows = with_copies(pages, **columns)
    with cleaned_up(pages.sparkSession):
        rows.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


# Reading


class Bytes:
    """A file's bytes from any place, a block at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def read(self, at: int, n: int = BLOCK) -> bytes:
        """Up to ``n`` bytes from ``at``."""
        end = min(at + n, self.size)
        if at < self.at or end > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, BLOCK))
        return self.held[at - self.at:end - self.at]

    def find(self, what: bytes, start: int, end: int) -> int | None:
        """The first place of ``what`` that starts in [start, end)."""
        at = start
        while at < end:
            block = self.read(at, min(BLOCK, end - at) + len(what) - 1)
            k = block.find(what)
            if k >= 0:
                return at + k
            at += max(1, len(block) - len(what) + 1)
        return None


class NotARecord(Exception):
    pass


def _pieces(data: Bytes, start: int) -> Iterator[tuple[bytes, int | None]]:
    """The bytes of the gzip member at ``start`` in pieces of bounded size, and at last where the member ends."""
    decoder, at = zlib.decompressobj(31), start
    while not decoder.eof:
        block = decoder.unconsumed_tail
        if not block:
            block = data.read(at)
            at += len(block)
            if not block:
                raise NotARecord("cut off")
        try:
            out = decoder.decompress(block, BLOCK)
        except zlib.error as error:
            raise NotARecord(str(error)) from None
        if out:
            yield out, None
    yield b"", at - len(decoder.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def header(data: Bytes, start: int) -> bytes:
    """The WARC header of the record at ``start`` up to its blank line, or :class:`NotARecord`."""
    held = b""
    for piece, _ in _pieces(data, start):
        held += piece
        if not held.startswith(b"WARC/"[:len(held)]):
            raise NotARecord("no WARC header")
        if (end := held.find(b"\r\n\r\n")) >= 0:
            return held[:end]
        if len(held) > HEADER_BYTES:
            break
    raise NotARecord("no end of the header")


def decoded(data: Bytes, start: int, keep: bool) -> tuple[int, dict, dict, int, str, bytes | None]:
    """The record at ``start``: where it ends, its WARC and HTTP fields, length and digest of its payload, and the payload
    if it is kept."""
    warc = http = None
    held, size, digest, kept, left, end = b"", 0, hashlib.sha256(), [], 0, 0
    for piece, end in _pieces(data, start):
        held += piece
        if warc is None and not held.startswith(b"WARC/"[:len(held)]):
            raise NotARecord("no WARC header")
        if warc is None and (k := held.find(b"\r\n\r\n")) >= 0:
            warc, held = _fields(held[:k]), held[k + 4:]
            if not warc.get("content-length", "").isdigit():
                raise NotARecord("no length")
            left = int(warc["content-length"])
            http = None if "application/http" in warc.get("content-type", "") else {}
        if warc is not None and http is None and (k := held.find(b"\r\n\r\n")) >= 0:
            http, held, left = _fields(held[:k]), held[k + 4:], left - k - 4
        if warc is not None and http is not None:
            take, held = held[:left], held[left:]
            left -= len(take)
            size += len(take)
            digest.update(take)
            if keep:
                kept.append(take)
        elif len(held) > 2 * HEADER_BYTES:
            raise NotARecord("no end of the header")
    if warc is None or http is None or left or held != b"\r\n\r\n":
        raise NotARecord("not whole")
    return end, warc, http, size, digest.hexdigest(), b"".join(kept) if keep else None


def _skip_empty(data: Bytes, at: int) -> int:
    """The first place from ``at`` on that is not one of the writer's empty members."""
    while data.read(at, len(EMPTY)) == EMPTY:
        at += len(EMPTY)
    return at


def owned(data: Bytes, start: int, end: int, keep: bool) -> Iterator[tuple]:
    """The records that start in [start, end): (offset, bytes, WARC fields, HTTP fields, length, digest, payload)."""
    at, sure = start, start == 0
    while at < end and (at := data.find(MAGIC, at, end)) is not None:
        try:
            found = decoded(data, at, keep)
            behind = _skip_empty(data, found[0])
            if not sure and behind < data.size:
                header(data, behind)
        except NotARecord:
            at += 1
            continue
        yield at, behind - at, *found[1:]
        at, sure = behind, True


def opened(path: str):
    """A file of a Hadoop-style path for reading at any place, in a task."""
    system, inside = file_system(path)
    return system.open_input_file(inside)


def ranges(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(path, length, start, end): the byte ranges of the files below ``path``, shuffled, so that they spread over tasks.
    A range has the session's bytes for a task (``spark.sql.files.maxPartitionBytes``) unless told otherwise."""
    if range_bytes is None:
        range_bytes = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "length")
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    return cut.withColumn("end", F.least(F.col("start") + range_bytes, "length")).repartition("path", "start")


def read_archive(spark: SparkSession, path: str, *, payloads: bool = False, range_bytes: int | None = None, open_file: Callable = opened) -> DataFrame:
    """A row for each record below ``path``: file, offset and bytes of it there, type, page_id, url, refers_to, length and
    digest of the full payload (a revisit's are those it tells), and with ``payloads`` the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with open_file(name) as file:
                    for offset, size, warc, http, n, digest, payload in owned(Bytes(file, length), start, end, payloads):
                        if warc.get("warc-type") == "revisit":
                            n, digest = int(http["content-length"]) if "content-length" in http else None, warc.get("warc-payload-digest", "").rpartition(":")[2] or None
                        rows.append((name, offset, size, warc.get("warc-type"), _id(warc.get("page-id")), warc.get("warc-target-uri"), _id(warc.get("refers-to-page-id")), n, digest, payload))
                        held += 500 + len(payload or b"")
                        if held >= FLUSH_BYTES:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return ranges(spark, path, range_bytes).mapInArrow(run, RECORD)


def _id(written: str | None) -> str | None:
    return None if written is None else unquote(written)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[kind]) for v, (_, kind) in zip(zip(*rows), columns)], names=[name for name, _ in columns])


def untiled(records: DataFrame, path: str) -> DataFrame:
    """(file, covered, length) of files that their records do not cover exactly: something in them was not understood."""
    files = records.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select(F.col("path").alias("file"), "length")
    covered = records.groupBy("file").agg(F.sum("bytes").alias("covered"))
    return files.join(covered, "file", "left").select("file", F.coalesce("covered", F.lit(0)).alias("covered"), "length").filter("covered <> length")


def archived(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, payloads: bool = False,
             range_bytes: int | None = None) -> DataFrame:
    """``pages`` written to the shared folder as archives and read back; the archives go when Python exits."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/glyphward-warc-{uuid.uuid4().hex}"
    write_archive(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, least=least)
    atexit.register(_delete, spark, path)
    kind = pages.schema[id_col].dataType
    found = read_archive(spark, path, payloads=payloads, range_bytes=range_bytes)
    return found.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
