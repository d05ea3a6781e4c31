"""WARC archives with a Zstandard dictionary of their own in a leading skippable frame."""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, scratch, stash

# Fixed values of the format: the skippable frame's magic number and the record's date if none is known.
DICTIONARY_MAGIC = 0x184D2A5D
UNKNOWN_DATE = "1970-01-01T00:00:00Z"

#: The dictionary is built from the archive's first records, up to so many bytes, and has at most so many.
SAMPLE_BYTES = 1 << 21
DICTIONARY_BYTES = 1 << 15
LEVEL = 3
#: Shorter payloads are never replaced by a revisit record.
REVISIT_BYTES = 100


def _clean(text: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _target(page_id: int | None, url: str | None) -> str:
    return _clean(url) if url else f"urn:page:{page_id}"


def record_id(page_id: int | None, digest: str, archive: int, place: int) -> str:
    """An id of its own for every record, repeated rows and rows without page_id included: its place in its archive is part of it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{archive}:{place}')}>"


def encode_record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """A response record with the payload, or (with refers_to) a revisit record that names the response's page, URI and date instead."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name, "WARC-Date": UNKNOWN_DATE,
        "WARC-Target-URI": _target(page_id, url), "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To-Target-URI"], head["WARC-Refers-To-Date"], head["X-Refers-To-Page-ID"] = _target(refers_to, refers_url), UNKNOWN_DATE, str(refers_to)
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's WARC header and its HTTP payload (empty for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; where there is too little to train on, the samples' own bytes serve as one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8, f=20, accel=1)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:].rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: Iterator[bytes]) -> tuple[int, int]:
    """Write records to a binary stream; the number of records and of bytes written."""
    first, size = [], 0
    for record in records:
        first.append(record)
        size += len(record)
        if size >= SAMPLE_BYTES:
            break
    dictionary = build_dictionary(first)
    body = dictionary.as_bytes()
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
    n, total = 0, 8 + len(body)
    for part in (first, records):
        for record in part:
            frame = compressor.compress(record)
            out.write(frame)
            n, total = n + 1, total + len(frame)
        first = None
    return n, total


def read_archive(source) -> Iterator[bytes]:
    """The records of a binary stream that write_archive() wrote, one at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    body = source.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind))
    frame, parts, data = context.decompressobj(), [], source.read(1 << 16)
    while data:
        parts.append(frame.decompress(data))
        data = frame.unused_data if frame.eof else b""
        if frame.eof:
            yield b"".join(parts)
            frame, parts = context.decompressobj(), []
        if not data:
            data = source.read(1 << 16)
    if any(parts):
        raise ValueError("the archive ends within a record")


def commit_file(folder: str, name: str, write: Callable) -> tuple[str, object]:
    """Write folder/name under a name of this attempt's own, then move it into place, so that retries do no harm."""
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as out:
        result = write(out)
    fs.move(draft, f"{base}/{name}")
    return f"{folder}/{name}", result


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to, refers_url): refers_to is the smallest page_id of equal payloads of at least REVISIT_BYTES bytes, where that isn't the page itself.

    Only payloads that occur more than once are joined back; where those are few Spark broadcasts them by their size on
    disk and the pages themselves are not shuffled. Beyond that the pages of a frequent payload are split over tasks.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    same = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
    same = stash(same.where("n > 1"), "revisits")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return join_hot(rows, same, "digest", ["page_id", "url"], how="left").select("page_id", "url", "html", "digest", refers.alias("refers_to"), F.col("first_url").alias("refers_url"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write rows of mark_revisits() to one archive per partition in folder; the manifest (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, place = TaskContext.get().partitionId(), itertools.count()

        def records():
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    page, url, html, digest, refers, refers_url = (x.as_py() for x in row)
                    yield encode_record(record_id(page, digest, archive, next(place)), page, url, html, digest, refers, refers_url)

        stream = records()
        head = next(stream, None)
        if head is None:
            return
        whole = (x for part in ([head], stream) for x in part)
        path, (n, size) = commit_file(folder, f"part-{archive:06d}.warc.zst", lambda out: write_archive(out, whole))
        yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    rows = pages.select("page_id", "url", F.col("html").cast("binary"), "digest", "refers_to", "refers_url")
    return stash(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) per record of the archives in manifest(path).

    A response's payload is checked against its digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        pack = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as source:
                    for head, payload in map(decode_record, read_archive(source)):
                        digest, length = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: a payload doesn't match its digest")
                        page, refers = (int(head[k]) if k in head else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
                        rows.append((page, head["WARC-Target-URI"], payload, length, digest, head["WARC-Type"], refers))
                        size += len(payload)
                        if size > 1 << 22:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive pages(page_id, url, html) and read the archives back: one row per page.

    Null html is an empty payload, a null url becomes urn:page:<id>, and a null page_id stays null. Of records with equal
    payloads of at least 100 bytes the one of the smallest page_id is the response (rows that repeat that id as
    well); smaller payloads are never revisits. Payloads of any length are one record each, held whole by the task that writes or reads it. Rows that repeat are a record each. Other columns are ignored. An empty table gives none.
    """
    return read_archives(write_archives(mark_revisits(pages), folder or scratch(pages.sparkSession, "warc")))
