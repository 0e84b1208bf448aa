"""WARC archives: written with an index first, read back by coalesced byte ranges.

Each record is a gzip member of its own, so a record is read alone from its
offset and length. The index, a written table, has a row per record: page_id,
path, offset, length, url, digest. A reader sorts the rows it wants by place
and joins neighbouring ranges into one read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.shared import opened, place, written

#: Payloads below this length are never written as revisits.
LEAST = 100
#: A read spans at most this many bytes, and skips at most so many.
READ, GAP = 8 << 20, 64 << 10
#: Bytes of the archives that a task reads, about.
TASK = 4 << 20
#: A file is closed once it has this many bytes.
FILE = 256 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A record before compression. A revisit has the HTTP head of its page, whose Content-Length is that of the full payload, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Characters of an URL that stay as they are in a header; others, `%` among them, are escaped, so any string comes back as it was.
SAFE = ":/?#[]@!$&'()*+,;=~"


def parse(data: bytes) -> dict:
    """The fields of an uncompressed record; `payload` is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"^([\w-]+): (.*?)\r?$", head.decode(), re.M))
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    page = re.fullmatch(r"<urn:x-page:(-?\d+|null)>", fields["WARC-Record-ID"])[1]
    to = fields.get("WARC-Refers-To")
    kind = fields["WARC-Type"]
    return {
        "page_id": None if page == "null" else int(page),
        "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "record_type": kind,
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "refers_to": None if to is None else int(to.split(":")[-1].rstrip(">")),
        "payload": body if kind == "response" else None,
    }


INDEX = "page_id long, path string, offset long, length long, url string, digest string"


def write_archives(pages: DataFrame, least: int = LEAST, file_bytes: int = FILE) -> DataFrame:
    """Writes pages (page_id, url, html; other columns are ignored) as WARC files in the shared folder; returns the index.

    Null html is an empty payload. Of records with equal payloads of at least
    `least` bytes the one with the smallest page_id is a response and those
    with larger ones are revisits of it; repeated rows of that page_id, and rows
    without page_id, are responses. An empty table gives an empty index.
    """
    at = place(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    keys = rows.filter(F.octet_length("html") >= least).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = keys.join(first, "digest").filter("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    rows = rows.join(later, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(at)
        fs.create_dir(top)
        part, out, path, offset, lines = TaskContext.get().partitionId(), None, "", 0, []
        try:
            for b in batches:
                for page, url, html, digest, to in zip(*(b.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    if out is None:
                        path, offset = f"{part:08d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{top}/{path}", compression=None)
                    page, url, digest = page.as_py(), url.as_py(), digest.as_py()
                    data = gzip.compress(record(page, url, html.as_py().encode(), digest, to.as_py()), 4, mtime=0)
                    out.write(data)
                    lines.append((page, f"{at}/{path}", offset, len(data), url, digest))
                    offset += len(data)
                    if offset >= file_bytes:
                        out.close()
                        out = None
                cols = list(zip(*lines, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "path", "offset", "length", "url", "digest"])
                lines.clear()
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(run, INDEX), "warc-index")


def ranges(rows: Iterator[tuple[str, int, int]], read: int = READ, gap: int = GAP) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Joins sorted (path, offset, length) into reads: (path, from, to, the places in it). A longer record is a read of its own."""
    path, start, end, held = "", 0, 0, []
    for p, offset, length in rows:
        if held and (p != path or offset - end > gap or max(end, offset + length) - start > read):
            yield path, start, end, held
            held = []
        if not held:
            path, start, end = p, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield path, start, end, held


FIELDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_records(selected: DataFrame, with_payload: bool = False, task_bytes: int = TASK) -> DataFrame:
    """Reads the records of these index rows (any subset of the index), about `task_bytes` of the archives in a task.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, and
    with `with_payload` url and payload (null for a revisit). A response's bytes
    and digest are those of the payload read; one that differs from its record
    raises a ValueError.
    """
    schema = FIELDS.append(pa.field("url", pa.string())).append(pa.field("payload", pa.binary())) if with_payload else FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True))
        name, file, rows = None, None, []

        def taken() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for path, start, end, places in ranges(wanted):
            if path != name:
                if file is not None:
                    file.close()
                fs, at = opened(path)
                name, file = path, fs.open_input_file(at)
            data = memoryview(file.read_at(end - start, start))
            for offset, length in places:
                x = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                if x["payload"] is not None:
                    if len(x["payload"]) != x["bytes"] or hashlib.sha256(x["payload"]).hexdigest() != x["digest"]:
                        raise ValueError(f"{path} at {offset}: the payload isn't the one that was written")
                row = (x["page_id"], x["bytes"], x["digest"], x["record_type"], x["refers_to"])
                rows.append((*row, x["url"], x["payload"]) if with_payload else row)
            yield taken()

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    places = selected.select("path", "offset", "length")
    # by bytes: the index is small, and by its own size one task would get all of it
    tasks = max(1, -(-(places.agg(F.sum("length")).first()[0] or 0) // task_bytes))
    places = places.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return places.mapInArrow(run, kind)
