"""WARC archives: a writer of gzip members, and a reader that splits files at any byte.

Writing: each partition becomes one archive of gzip members, one member a record. Records with equal payloads share
one response, that with the smallest page id; the others are revisits, which keep the response headers and the
payload's digest and name the response.

Reading: an archive is cut into byte ranges without looking into it, and the ranges are dealt evenly over tasks. A task
scans its range for the gzip magic, takes a place for a member only if it decodes to a whole block of WARC headers
(version line, type, id, date, length), and owns the records that start inside its range; the last one may end beyond
it. So each record is read once, whatever the cuts. Behind a record the next one must start, or the file ends. A file is
read forward through one window, so that a range costs its own bytes and the rest of its last record.

Files go through pyarrow's file systems by a full address, which Spark's own file systems give for a folder, so that
a path without a scheme means the same folder to all. Schemes: file, hdfs, viewfs, s3 (and s3a, s3n), gs, abfs and abfss
(and wasb, wasbs); others raise. A writing task that is run again puts the same bytes in the same place, under a name of
its own first, and then moves them; on an object store the move is a copy, which another task never reads, as readers get
the archives' names only when all are written.

Defined cases: a null payload is an empty payload and counts as equal to other empty ones; a null url is written
without a target; white space in a url is written as single spaces, as a header is one line; headers of any length are read; a null page id is never the smallest while another is there, and of equal payloads without any
id all are responses; rows that share the smallest id are all responses, other repeated rows revisit; an empty table
gives no records; columns besides key, url and payload are not written, so that their names cannot clash. A record that
is cut off, does not decompress or is not as long as its headers say raises ValueError.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratia.llm.common import fresh, slices, table
from stratia.session import materialize, qualified, scratch

MAGIC, VERSION, SPLIT, LEVEL = b"\x1f\x8b\x08", b"WARC/1.1\r\n", 8 << 20, 6
#: Bytes that are read at once, and bytes of a candidate that are unpacked at once.
WINDOW, PROBE = 1 << 18, 1 << 12
#: Digests of repeated payloads that are sent to all tasks; of more, the rows meet them in a shuffled join.
MOST_SENT = 250_000
#: Schemes of Hadoop's file systems by the names that pyarrow has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
#: Tasks that read archives.
MOST_TASKS = 100_000
#: Fields without which a block of headers is not a record's.
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PREFIX, DATE = "urn:page:", "2020-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def address(folder: str) -> str:
    """A full address in the scheme that pyarrow's file systems know."""
    scheme, colon, rest = folder.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if colon else folder


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    body = http + (payload if refers_to is None else b"")
    name = PREFIX + ("none" if page_id is None else str(page_id))
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _gzip(VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


def with_responses(pages: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """pages with `refers_to`: of rows with equal payloads the smallest key, null for the rows that have it.

    Only (digest, key) pairs are grouped, and only digests that repeat are kept. Up to MOST_SENT of them go to all tasks,
    so that payloads stay where they are; of more, rows meet them by digest, in a join whose large side Spark may
    split where many rows share a payload.
    """
    if "refers_to" in {c.lower() for c in pages.columns}:
        raise ValueError("the input has a column named refers_to")
    digest, first, n = fresh(pages, "digest_", "first_", "n_")
    marked = pages.withColumn(digest, F.sha2(F.coalesce(F.col(payload), F.lit("")).cast("binary"), 256))
    long_enough = F.coalesce(F.octet_length(payload), F.lit(0)) >= least_bytes
    firsts = marked.filter(long_enough).groupBy(digest).agg(F.min(key).alias(first), F.count("*").alias(n)).filter(F.col(n) > 1).select(digest, first)
    firsts = materialize(firsts, "warc-digests")
    joined = marked.join(F.broadcast(firsts) if firsts.count() <= MOST_SENT else firsts, digest, "left")
    same = F.coalesce(F.col(key) == F.col(first), F.lit(False))
    return joined.withColumn("refers_to", F.when(~same, F.col(first))).drop(digest, first)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write one archive a partition into the folder; (path, length, records) of each."""
    rows = with_responses(pages.select(key, url, payload), key, payload, least_bytes).select(key, url, payload, "refers_to")
    folder = address(qualified(pages.sparkSession, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part, n, out = f"{base}/part-{context.partitionId():06d}.warc.gz", 0, None
        trial = f"{base}/_{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        for b in slices(batches, payload):
            for k, u, p, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(trial)
                data = (p or "").encode()
                out.write(record(k, u, data, payload_digest(data), r))
                n += 1
        if out is not None:
            length = out.tell()
            out.close()
            fs.move(trial, part)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([length], pa.int64()), pa.array([n], pa.int64())], names=["path", "length", "records"])

    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    return rows.mapInArrow(run, "path string, length long, records long")


class _Window:
    """A file's bytes from one place on, read forward; what lies behind is dropped."""

    def __init__(self, file, at: int):
        self.file, self.start, self.held = file, at, bytearray()
        file.seek(at)

    def upto(self, end: int) -> None:
        """Hold the bytes up to `end`, or to the end of the file."""
        while (short := end - self.start - len(self.held)) > 0:
            data = self.file.read(max(WINDOW, short))
            if not data:
                return
            self.held += data

    def bytes(self, at: int, n: int) -> bytes:
        self.upto(at + n)
        return bytes(self.held[at - self.start : at - self.start + n])

    def find(self, mark: bytes, at: int, end: int) -> int:
        """The first place in [at, end) where mark starts, or -1."""
        while at < end:
            self.upto(at + len(mark))
            stop = min(end + len(mark) - 1, self.start + len(self.held))
            found = self.held.find(mark, at - self.start, stop - self.start)
            if found >= 0:
                return self.start + found
            if stop - at < len(mark):
                return -1
            at = stop - len(mark) + 1
            self.drop(at)
        return -1

    def drop(self, at: int) -> None:
        del self.held[: max(0, at - self.start)]
        self.start = max(self.start, at)


def header_fields(head: bytes) -> dict[str, str] | None:
    """The fields, by lower-case name, of a record's header lines; None if they are no WARC headers."""
    if not head.startswith(b"WARC/1."):
        return None
    try:
        lines = head.decode().split("\r\n")[1:]
        fields = {name.lower(): value.strip() for name, value in (line.split(":", 1) for line in lines)}
    except ValueError:  # no text, or a line without a colon
        return None
    return fields if all(fields.get(name) for name in NEEDED) and fields["content-length"].isdigit() else None


def _may_be_headers(data: bytes | bytearray, at: int = 0) -> bool:
    """Whether decoded bytes without an empty line can still become a record's headers: each whole line from `at` on has a colon."""
    front = b"WARC/1."
    if bytes(data[: len(front)]) != front[: len(data)]:
        return False
    lines = bytes(data[at:]).split(b"\r\n")[:-1]
    return all(b":" in x for x in (lines[1:] if at == 0 else lines))


def _starts_record(data: bytes) -> bool:
    """Whether the first bytes that decode begin a record's headers, whatever follows."""
    unpack, out = zlib.decompressobj(31), b""
    with contextlib.suppress(zlib.error):
        for at in range(0, len(data), 16):
            out += unpack.decompress(data[at : at + 16])
    head, blank, _ = out.partition(b"\r\n\r\n")
    return header_fields(head) is not None if blank else len(out) > 7 and _may_be_headers(out)


def member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """(decoded record, the place behind it) of the member at a place; None if no WARC headers decode there."""
    unpack, out, place, known, seen = zlib.decompressobj(31), bytearray(), at, None, 0
    step = PROBE
    while not unpack.eof:
        data = window.bytes(place, step)
        if not data:
            break
        if known:
            window.drop(place)  # all but this piece, in which the member may end
        step = min(2 * step, WINDOW)
        try:
            out += unpack.decompress(data)
        except zlib.error as e:
            if known or _starts_record(window.bytes(at, PROBE)):
                raise ValueError(f"a record at byte {at} is damaged: {e}") from None
            return None
        place += len(data)
        if not known:
            end = out.find(b"\r\n\r\n", max(seen - 2, 0))
            if end >= 0 or unpack.eof:
                known = header_fields(bytes(out[:end])) if end >= 0 else None
                if known is None:
                    return None
            elif not _may_be_headers(out, seen):
                return None
            seen = max(out.rfind(b"\r\n") + 2, seen) if b"\r\n" in out[seen:] else seen
    if not known:
        return None
    if not unpack.eof:
        raise ValueError(f"a record at byte {at} is cut off")
    if len(out) != end + 4 + int(known["content-length"]) + 4:
        raise ValueError(f"a record at byte {at} is not as long as its headers say")
    return bytes(out), place - len(unpack.unused_data)


def records(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of the records that start in [start, end) of a file."""
    window, at, behind = _Window(file, start), start, start == 0
    while at < min(end, size):
        if not behind:
            at = window.find(MAGIC, at, end)
            if at < 0:
                return
        window.drop(at)
        found = member(window, at)
        if found is None and behind:
            raise ValueError(f"no record starts at byte {at}")
        if found is None:
            at += 1  # the magic's bytes inside compressed data
            continue
        yield at, found[0]
        at, behind = found[1], True


def _page(name: str | None) -> int | None:
    """The page id in a record's name; None for other names."""
    number = (name or "").strip("<>").removeprefix(PREFIX)
    return int(number) if number.lstrip("-").isdigit() else None


def parse(whole: bytes) -> dict:
    """Type, ids, url, digest, the payload of a response and the payload's length of either kind."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = header_fields(head)
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    sent = dict((name.lower(), value.strip()) for name, colon, value in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:]) if colon)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and digest and payload_digest(payload) != digest:
        raise ValueError("a payload's digest differs from its record's")
    size = int(sent["content-length"]) if kind == "revisit" and sent.get("content-length", "").isdigit() else len(payload)
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page(fields.get("warc-refers-to"))}


READ = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(files: DataFrame, folder: str, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """One row a record of the given archives (path, length), each file read in ranges of `split` bytes.

    There are as many tasks as ranges, up to MOST_TASKS; beyond that a task reads several, one after the other.
    """
    folder = address(qualified(files.sparkSession, folder))
    many = files.agg(F.sum(F.ceil(F.col("length") / split)).alias("n")).first()["n"] or 1
    fields = [f for f in READ if payloads or f.name != "payload"]
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.repartitionByRange(int(max(1, min(many, MOST_TASKS))), "path", "start")
    kinds = {pa.string(): T.StringType(), pa.int64(): T.LongType(), pa.binary(): T.BinaryType()}
    schema = T.StructType([T.StructField(f.name, kinds[f.type]) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(folder)[0]
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(path) as file:
                    held, held_bytes = [], 0
                    for offset, whole in records(file, size, start, min(start + split, size)):
                        held.append({"path": path, "offset": offset} | parse(whole))
                        held_bytes += len(whole)
                        if held_bytes > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, pa.schema(fields))
                            held, held_bytes = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, pa.schema(fields))

    return ranges.mapInArrow(run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write archives into the shared folder and read them back: one row a record."""
    folder = scratch(pages.sparkSession, "warc")
    files = materialize(write(pages, folder, key, url, payload, least_bytes), "warc-files")
    return read(files, folder, payloads=False)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_sql() -> str:
    return """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
        first AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
        SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1), 1) for i in range(32)], '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM p JOIN first USING (html)
    """
