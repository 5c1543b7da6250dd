"""WARC archives: a writer with revisit records, and a splittable reader.

The reader cuts archives into byte ranges.  A task scans its range for the gzip
magic, accepts a candidate only if its member inflates to a WARC header, and
owns the records that start inside its range, reading past the end for the
last one.  Nothing but the file sizes is known beforehand.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.storage import cut, fresh

#: Payloads of fewer bytes are always stored; archive and split sizes in bytes.
MIN_REVISIT, ARCHIVE_BYTES, SPLIT_BYTES = 1000, 32 << 20, 4 << 20
#: Digests that are looked up in a broadcast table: the most frequent ones, so any other has at most one page in so many.
HOT_DIGESTS = 1000
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(page_id + (1 << 63)) if page_id is not None else (1 << 64), version=None)}>"


def _page_of(urn: str | None) -> int | None:
    """The page_id in a record id that _urn made; None for any other id."""
    try:
        number = uuid.UUID((urn or "").strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    return None if number >= 1 << 64 else number - (1 << 63)


def target_uri(url: str | None) -> str:
    """The URL in printable ASCII; every other character as its percent-encoded UTF-8 bytes."""
    return urllib.parse.quote(url, safe="".join(map(chr, range(0x21, 0x7F)))) if url else "urn:none"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member.  The digest is hex SHA-1 and is written in base 32, as is usual."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target_uri(url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = _HTTP if revisit else _HTTP + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _writer(root: str):
    def run(batches):
        system, base = _system(root)
        out, name, temporary, size, written = None, "", "", 0, []

        def close():
            nonlocal out
            out.close()
            # Visible under its final name only when it is whole; a task that is run again writes other names.
            system.move(temporary, f"{base}/{name}")
            written.append((f"{root}/{name}", size))
            out = None

        for batch in batches:
            for row in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
                if out is None:
                    name, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    system.create_dir(f"{base}/_unfinished", recursive=True)
                    temporary = f"{base}/_unfinished/{name}"
                    out = system.open_output_stream(temporary, compression=None)
                member = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["revisit"])
                out.write(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in written], pa.string()), pa.array([x[1] for x in written], pa.int64())], ["path", "bytes"])

    return run


def write_warc(pages: DataFrame, root: str) -> DataFrame:
    """Writes a record for each row of `pages` (page_id, url, html) to archives under `root`, a folder
    that driver and executors share; returns the table (path, bytes) of the archives.

    Payload: html in UTF-8, null as none.  Of rows with equal payloads of
    MIN_REVISIT bytes or more, one with the largest page_id is a response and
    the others are revisits that refer to it; a null page_id counts as the
    smallest.  Equal rows that share the largest page_id are responses all.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= MIN_REVISIT
    # Only digests that occur twice matter.  One of them may hold a third of all pages: the most frequent ones, a
    # bounded number of rows, are broadcast, and their pages go to the join under keys of their own, as short ones do.
    repeated = cut(pages.where(long).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("largest")).where("n > 1"), "digests")
    hot = repeated.orderBy(F.desc("n"), "digest").limit(HOT_DIGESTS).select("digest", F.col("largest").alias("hot_largest"), F.lit(True).alias("is_hot"))
    marked = pages.join(F.broadcast(hot), "digest", "left")
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    marked = marked.withColumn("key", F.when(long & F.col("is_hot").isNull(), F.col("digest")).otherwise(own))
    known = marked.join(repeated.select(F.col("digest").alias("key"), "largest"), "key", "left")
    known = known.withColumn("largest", F.when(long, F.coalesce("hot_largest", "largest")))
    revisit = F.coalesce(F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")), F.lit(False))
    known = known.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("largest")).alias("refers_to"), revisit.alias("revisit"))
    return cut(known.mapInArrow(_writer(root), "path string, bytes long"), "archives")


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


class _Window:
    """Bytes of a file from an offset on, read as needed."""

    def __init__(self, stream, start: int, size: int):
        self.stream, self.size, self.at, self.data = stream, size, start, b""

    def upto(self, end: int) -> bool:
        """Whether bytes before `end` are there, after reading them."""
        while self.at + len(self.data) < min(end, self.size):
            more = self.stream.read_at(min(1 << 20, self.size - self.at - len(self.data)), self.at + len(self.data))
            if not more:
                break
            self.data += more
        return self.at + len(self.data) >= end

    def drop(self, start: int) -> None:
        self.data, self.at = self.data[start - self.at :], start


def _member(window: _Window, start: int):
    """(end offset, content) of the gzip member at `start`, or None if no WARC record starts there."""
    unpack, parts, at, checked = zlib.decompressobj(31), [], start, False
    try:
        while not unpack.eof:
            if not window.upto(at + 1):
                return None
            chunk = window.data[at - window.at : at - window.at + (1024 if not checked else 1 << 18)]
            parts.append(unpack.decompress(chunk))
            at += len(chunk)
            if not checked and sum(map(len, parts)) >= len(_VERSION):
                checked = True
                if not b"".join(parts).startswith(_VERSION):
                    return None
    except zlib.error:
        return None
    content = b"".join(parts)
    return (at - len(unpack.unused_data), content) if content.startswith(_VERSION) else None


def read_range(path: str, start: int, end: int, size: int):
    """(headers, block) of the records of one archive that start in [start, end)."""
    system, name = _system(path)
    with system.open_input_file(name) as stream:
        window, at = _Window(stream, start, size), start
        while at < min(end, size):
            window.upto(min(end, at + (1 << 20)) + len(_MAGIC))
            found = window.data.find(_MAGIC, at - window.at)
            if found < 0:  # a magic may straddle what has been read
                at = max(at + 1, window.at + len(window.data) - len(_MAGIC) + 1)
                window.drop(min(at, window.at + len(window.data)))
                continue
            at = window.at + found
            if at >= end:
                return
            got = _member(window, at)
            if got is None:
                at += 1
                continue
            at, content = got
            head, _, rest = content.partition(b"\r\n\r\n")
            headers = _headers(head)
            length = headers.get("content-length", "")
            yield headers, rest[: int(length)] if length.isdigit() else rest
            window.drop(min(at, window.at + len(window.data)))


def _declared(headers: dict[str, str]) -> str | None:
    """The hex SHA-1 that a record states for its payload, in base 32 or hex; None for none or another kind."""
    kind, _, value = headers.get("warc-payload-digest", "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return (bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())).hex()
    except ValueError:
        return None


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers.get("warc-type")
    http = headers.get("content-type", "").lower().startswith("application/http")
    payload, declared = block.partition(b"\r\n\r\n")[2] if http else block, _declared(headers)
    if kind == "revisit":  # what it stands for is told by its headers only
        length = headers.get("x-payload-length", "")
        size, digest, intact, payload = int(length) if length.isdigit() else None, declared, None, None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        intact = None if declared is None else declared == digest
    return (_page_of(headers.get("warc-record-id")), kind, _page_of(headers.get("warc-refers-to")) if kind == "revisit" else None, headers.get("warc-target-uri"), payload, size, digest, headers.get("warc-record-id"), intact)


RECORDS = "page_id long, record_type string, refers_to long, target_uri string, payload binary, payload_bytes long, payload_digest string, record_id string, intact boolean"


def _reader(batches):
    kinds = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string()), ("intact", pa.bool_())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    for batch in batches:
        for split in batch.to_pylist():
            rows, held = [], 0
            for headers, block in read_range(split["path"], split["start"], split["end"], split["bytes"]):
                rows.append(_row(headers, block))
                held += len(block)
                if held > 4 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of `archives` (path, bytes): page_id, record_type, refers_to, target_uri (percent-encoded),
    payload, payload_bytes, payload_digest (hex SHA-1; of the full payload), record_id, intact.

    Any gzip-member archive can be read.  record_type is the record's own, also
    warcinfo, request, metadata and others; page_id and refers_to are null where
    the ids are not those of write_warc; a payload is the block behind its HTTP
    headers, or the whole block where there are none.  Of a revisit payload is
    null, and length and digest are those it states, null where it states none.
    intact says whether the payload has the SHA-1 that the record states, null
    without one.

    Every `split_bytes` of an archive are a unit of work of their own; an
    archive without records, or none, gives no rows.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = archives.where("bytes > 0").withColumn("start", starts).withColumn("end", F.col("start") + split_bytes)
    # Ranges are a few bytes a row; dealt out evenly, so that each task gets a like share of the archives.
    parallel = archives.sparkSession.sparkContext.defaultParallelism
    return splits.repartition(4 * parallel, "path", "start").mapInArrow(_reader, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes `pages` to archives in the shared folder and reads them back; a payload without its digest is an error."""
    read = read_warc(write_warc(pages, fresh(spark, "warc")))
    damaged = F.raise_error(F.concat(F.lit("damaged record "), F.coalesce("record_id", F.lit("")))).cast("string")
    return read.withColumn("record_type", F.when(F.coalesce("intact", F.lit(True)), F.col("record_type")).otherwise(damaged))
