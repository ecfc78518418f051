"""WARC writing, normalising and reading back.

Each task writes its pages as one monolithic gzip stream (``write_archives``). The normaliser
(``normalise_archives``) inflates every stream once, front to back, rewrites each record as a
gzip member of its own and writes a sidecar index of offsets. ``read_archives`` seeks by that
index and checks every payload against its digest. Only buffers of ``CHUNK`` bytes and one
record's headers are held, whatever a record's length.

A task writes under a name of its own attempt, and the manifest that Spark commits names the
file: archives of lost or repeated attempts are never read.

Defined cases: null html is an empty payload; a null url has no WARC-Target-URI; a null page_id
is carried as null and is never the original if a group has another id; rows that repeat the
original's page_id and payload are responses too; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import whole_text, written

CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "archive string, records long, bytes long"
INDEX = "archive string, record_offset long, record_length long, page_id long, url string"
ANSWER = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(uri: str):
    """The pyarrow file system of a shared folder, and the folder's path there."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1, refers_to: of equal payloads of ``min_bytes`` or more the
    smallest page_id is the original, the others refer to it."""
    rows = pages.select("page_id", "url", F.encode(whole_text("html"), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    marks = rows.filter(F.length("payload") >= min_bytes).select("page_id", "sha1")
    # counted by task first: an original with very many copies is one row per task
    first = marks.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1 and refers_to is not null").select(F.col("sha1").alias("_sha1"), "refers_to")
    copies = marks.distinct().join(first, F.col("sha1") == F.col("_sha1")).filter(
        ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(
        F.col("page_id").alias("_page"), "_sha1", "refers_to")
    return rows.join(copies, rows["page_id"].eqNullSafe(copies["_page"]) & (rows["sha1"] == copies["_sha1"]),
                     "left").select("page_id", "url", "payload", "sha1", "refers_to")


def _name(page) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def _page(name: str):
    n = name.strip()[1:-1].rpartition(":")[2]
    return None if n == "null" else int(n)


def record_head(page, url, payload_bytes: int, sha1: bytes, refers_to) -> tuple[bytes, bytes]:
    """WARC headers and HTTP headers of one record; a revisit has the HTTP headers only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {payload_bytes}\r\n\r\n").encode()
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page)}",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + json.dumps(url)[1:-1])  # one line, whatever the url holds
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_name(refers_to)}")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(http) + (0 if revisit else payload_bytes)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Writes one monolithic .warc.gz for each partition; gives the manifest."""
    def write(batches):
        import pyarrow as pa
        fs, base = _filesystem(folder)
        out = packer = None
        records = 0
        path = f"{base}/whole-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for page, url, payload, sha1, ref in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out, packer = fs.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                body = memoryview(payload.as_buffer())
                ref = ref.as_py()
                head, http = record_head(page.as_py(), url.as_py(), len(body), sha1.as_py(), ref)
                out.write(packer.compress(head + http))
                for at in range(0, len(body) if ref is None else 0, CHUNK):
                    out.write(packer.compress(body[at:at + CHUNK]))
                out.write(packer.compress(b"\r\n\r\n"))
                records += 1
        if out is not None:
            out.write(packer.flush())
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path], "records": [records], "bytes": [size]})

    return marked.mapInArrow(write, MANIFEST)


class Inflated:
    """A gzip file inflated once, front to back; what is held is at most a few chunks."""

    def __init__(self, source):
        self.source, self.inflater, self.held, self.over = source, zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        if self.inflater.eof:  # a further member
            data = self.inflater.unused_data or self.source.read(CHUNK)
            if not data:
                return False
            self.inflater = zlib.decompressobj(31)
        else:
            data = self.inflater.unconsumed_tail or self.source.read(CHUNK)
        got = self.inflater.decompress(data, CHUNK)
        if not (data or got or self.inflater.eof):
            raise EOFError("the archive ends inside a gzip member")
        self.held += got
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``; empty at the end of the file."""
        while mark not in self.held:
            if not self._more():
                if self.held:
                    raise EOFError("the archive ends inside a record")
                return b""
        got, _, self.held = self.held.partition(mark)
        return got + mark

    def some(self, most: int) -> bytes:
        """At least one and at most ``most`` bytes."""
        while not self.held:
            if not self._more():
                raise EOFError("the archive ends inside a record")
        got, self.held = self.held[:most], self.held[most:]
        return got


def head_fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise_stream(source, sink) -> list[tuple]:
    """Rewrites every record of ``source`` as a gzip member of ``sink``; gives the offset index."""
    whole, index, at = Inflated(source), [], 0
    while head := whole.until(b"\r\n\r\n"):
        fields = head_fields(head)
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        length = 0
        for piece in _record(whole, head, int(fields["Content-Length"])):
            length += sink.write(packer.compress(piece)) or 0
        length += sink.write(packer.flush()) or 0
        end = sink.tell()
        url = fields.get("WARC-Target-URI")
        index.append((at, end - at, _page(fields["WARC-Record-ID"]), None if url is None else json.loads(f'"{url}"')))
        at = end
    return index


def _record(whole: Inflated, head: bytes, left: int):
    yield head
    while left:
        piece = whole.some(min(left, CHUNK))
        left -= len(piece)
        yield piece
    yield whole.until(b"\r\n\r\n")


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Normalises each archive of the manifest; writes a .cdxj sidecar and gives its rows."""
    def normalise(batches):
        import pyarrow as pa
        fs, base = _filesystem(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                path = f"{base}/member-{uuid.uuid4().hex}.warc.gz"
                with fs.open_input_stream(archive, compression=None, buffer_size=CHUNK) as source, \
                        fs.open_output_stream(path, compression=None, buffer_size=CHUNK) as sink:
                    index = normalise_stream(source, sink)
                with fs.open_output_stream(path + ".cdxj") as side:
                    for o, n, page, url in index:
                        side.write((json.dumps({"offset": o, "length": n, "page_id": page, "url": url}) + "\n").encode())
                for i in range(0, len(index), 4096):
                    o, n, page, url = zip(*index[i:i + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(o)), pa.array(o, pa.int64()), pa.array(n, pa.int64()),
                         pa.array(page, pa.int64()), pa.array(url, pa.string())],
                        ["archive", "record_offset", "record_length", "page_id", "url"])

    return manifest.mapInArrow(normalise, INDEX)


def read_record(raw) -> dict:
    """One gzip member: its WARC fields, and its payload's length and digest where it has one."""
    whole = Inflated(raw)
    fields = head_fields(whole.until(b"\r\n\r\n"))
    left = int(fields["Content-Length"])
    http = whole.until(b"\r\n\r\n")
    left -= len(http)
    told, digest = int(head_fields(http)["Content-Length"]), fields["WARC-Payload-Digest"].partition(":")[2]
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit:
        sha1, size = hashlib.sha1(), left
        while left:
            piece = whole.some(min(left, CHUNK))
            left -= len(piece)
            sha1.update(piece)
        if base64.b32encode(sha1.digest()).decode() != digest or size != told:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its record")
    return {"page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": told, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None}


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the index, found by its offset and read back."""
    def read(batches):
        import io

        import pyarrow as pa
        opened = (None, None)
        for batch in batches:
            rows = []
            for archive, at, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if opened[0] != archive:
                    fs, path = _filesystem(archive if "://" in archive else "file:" + archive)
                    opened = (archive, fs.open_input_file(path))
                opened[1].seek(at)
                rows.append(read_record(io.BytesIO(opened[1].read(n))))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                 ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return index.mapInArrow(read, ANSWER)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` as WARC, normalises the archives and reads them back:
    page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    manifest = written(write_archives(mark_revisits(pages, min_bytes), folder), "warc-manifest")
    one_each = manifest.repartition(max(1, manifest.count()), "archive")
    index = written(normalise_archives(one_each, folder), "warc-index")
    return read_archives(index)


#: DuckDB has no SHA-1 and no base32; the test compares with hashlib instead.
ORACLE = None
