"""WARC archives: write records with an index, read selected records back by byte ranges.

Writing: each task appends one gzip member per record to a file of its own and
returns an index row (file, offset, length, URL, digest) for it. A file carries the
task attempt's number in its name and the index is committed by Spark, so the index
names only files of attempts that succeeded.

Reading: the index is filtered first, sorted by file and offset, and neighbouring
byte ranges are fetched with one read as long as the gap between them is small.

Files go through ``pyarrow.fs``: local paths, object stores and HDFS alike.

Blocks are HTTP responses; a revisit has the head alone. Record ids are made of file and offset, so they never
repeat; pages are named by the extension fields ``X-Page-ID`` and ``X-Refers-To-Page``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intronaut.scratch import materialize, scratch_path

INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, file string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Largest gap read over rather than seeking, and largest single read.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
#: A file is closed and the next begun at this size.
FILE_BYTES = 1 << 30
#: Bytes of archives that a task reads, about.
TASK_BYTES = 32 << 20
LEVEL = 3


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None, refers_url: str | None, dated: str, place: str) -> bytes:
    """One WARC/1.1 record written at ``place``; without payload, a revisit of the record of page ``refers_to``."""
    revisit = payload is None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(place.encode()).digest(), version=5)}>"),
        ("WARC-Date", dated),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "null" if page_id is None else str(page_id)),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", _line(refers_url)), ("WARC-Refers-To-Date", dated), ("X-Refers-To-Page", str(refers_to))]
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, dated: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, out, at, name = 0, None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, digest, size, first, first_url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "payload_bytes", "first", "first_url", "payload")), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{part}.warc.gz"
                        out, at, part = store.open_output_stream(name, compression=None), 0, part + 1
                    revisit = first is not None and first != page_id
                    data = _gzip(record(page_id, url, digest, size, None if revisit else html or b"", first, first_url, dated, f"{name}:{at}"))
                    out.write(data)
                    rows.append((page_id, url, digest, size, "revisit" if revisit else "response", name, at, len(data)))
                    at += len(data)
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "digest", "payload_bytes", "record_type", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, dated: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder`` and return the index.

    ``dated`` is the time of all captures, as in 2024-01-31T12:00:00Z; without it, the time of writing.
    The payload is html in UTF-8, empty for null. Of records with equal payloads of at
    least ``least_bytes`` bytes the one with the smallest page_id is a response and the others revisit
    it; smaller ones are all responses. Rows without page_id revisit, unless no equal payload has an id.
    Repeated rows of the response's page_id are responses as well.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32(F.sha1("payload"))).withColumn("payload_bytes", F.length("payload").cast("long"))
    # equal payloads agree in length and in two digests
    same = ("digest", "second", "payload_bytes")
    rows = rows.withColumn("second", F.sha2("payload", 256))
    firsts = rows.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy(*same).agg(F.min(F.struct("page_id", "url")).alias("f"))
    # written, so that the join is between two exchanges and Spark may split the rows of a page that many repeat
    firsts = materialize(firsts.select(*same, F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")), "firsts")
    dated = dated or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return materialize(rows.join(firsts, list(same), "left").drop("second").mapInArrow(_writer(folder, dated), INDEX), "warc_index")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32(hex_digest: Column) -> Column:
    """Base32 of 40 hexadecimal digits: four groups of 10 digits are eight base-32 digits each."""
    groups = [F.translate(F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0"), _DIGITS, _ALPHABET) for i in range(4)]
    return F.concat(*groups)


def ranges(rows: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(offset, length) sorted by offset -> (first row, last row exclusive, from, to) of each coalesced read."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(rows):
        if out and offset - out[-1][3] <= GAP_BYTES and offset + length - out[-1][2] <= READ_BYTES:
            first, _, low, high = out[-1]
            out[-1] = (first, i + 1, low, max(high, offset + length))
        else:
            out.append((i, i + 1, offset, offset + length))
    return out


def _reader(folder: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0]
        opened, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            begin = 0
            while begin < len(files):
                end = begin
                while end < len(files) and files[end] == files[begin]:
                    end += 1
                if opened != files[begin]:
                    if source is not None:
                        source.close()
                    opened, source = files[begin], store.open_input_file(files[begin])
                for first, last, low, high in ranges(list(zip(offsets[begin:end], lengths[begin:end], strict=True))):
                    data, rows = source.read_at(high - low, low), []
                    for i in range(begin + first, begin + last):
                        fields, block = parse(zlib.decompress(data[offsets[i] - low : offsets[i] - low + lengths[i]], 31))
                        rows.append(_row(fields, block, payloads))
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                begin = end
        if source is not None:
            source.close()

    return read


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    number = lambda x: None if x in (None, "null") else int(x)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    if kind == "response" and (_digest(payload) != digest or len(payload) != size):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not have the payload that its header states")
    return number(fields["X-Page-ID"]), fields["WARC-Target-URI"], size, digest, kind, number(fields.get("X-Refers-To-Page")), payload if payloads and kind == "response" else None


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name, each checked against its digest.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null
    for revisits or without ``payloads``).
    """
    wanted = index.select("file", "offset", "length")
    # dealt by bytes of archives: the index itself is so small that Spark would give it to one task
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(n, max(-(-size // TASK_BYTES), index.sparkSession.sparkContext.defaultParallelism)))
    wanted = wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(_reader(folder, payloads), RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read every record back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes), folder, payloads=False)
