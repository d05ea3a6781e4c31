"""Token ids as length-delimited binary records with masked checksums and a separate offset index."""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stash
from .warc import commit_file

# Fixed value of the framing: what is added to a rotated checksum, so that checksums of data that hold checksums stay sound.
MASK_DELTA = 0xA282EAD8
#: Frame: length, its masked checksum, the payload, its masked checksum.
_HEAD, _TAIL = "<QI", "<I"
_AROUND = struct.calcsize(_HEAD) + struct.calcsize(_TAIL)
#: Payload: flags (1: doc_id known, 2: ids of 4 bytes instead of 2), doc_id, ids.
_PAYLOAD = "<Bq"
#: Text, in bytes, that one file may hold, unless spark.sql.shuffle.partitions asks for more files.
PART_BYTES = 1 << 28
#: Words whose ids a worker remembers.
WORD_CACHE = 300_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack(_TAIL, masked(size)) + payload + struct.pack(_TAIL, masked(payload))


def unframe(source) -> bytes | None:
    """The next payload of a binary stream, checked; None at its end."""
    head = source.read(struct.calcsize(_HEAD))
    if not head:
        return None
    size, check = struct.unpack(_HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length doesn't match its checksum")
    payload = source.read(size)
    if len(payload) != size or masked(payload) != struct.unpack(_TAIL, source.read(struct.calcsize(_TAIL)))[0]:
        raise ValueError("a record doesn't match its checksum")
    return payload


def pack_ids(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return struct.pack(_PAYLOAD, (doc_id is not None) | wide << 1, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from(_PAYLOAD, payload)
    return doc_id if flags & 1 else None, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=struct.calcsize(_PAYLOAD))


class WordTokenizer:
    """A tokenizers file applied word by word, remembering each word's ids.

    For tokenizers that drop white space, never merge across it and split letters from other characters: there the ids of a text are
    those of its white-space separated words in turn, and the ids of letters followed by plain punctuation are those of
    the letters and of the punctuation. Words of letters go straight to the library's merge model, after its
    normalizer (for Latin letters the same form and case from Python's own tables); every other word, those that hold a special token's
    string among them, takes the library's whole path.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.merge = self.full.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = (b for b in range(256) if b not in set(plain))
        self.byte_chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes | None] = {}

    def _whole(self, word: str) -> bytes:
        return array("I", self.full.encode(word, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes | None:
        if word.isascii():
            plain = word.lower()
        else:
            latin = max(word) < "\u0180"  # no letter of these depends on its context or on the version of Unicode
            plain = unicodedata.normalize("NFC", word).lower() if latin else self.full.normalizer.normalize_str(word)
            if not plain.isalpha() or not latin and any(unicodedata.category(c) == "Cn" for c in plain):
                return None
            plain = plain.encode().decode("latin-1").translate(self.byte_chars)
        return array("I", [t.id for t in self.merge.tokenize(plain)]).tobytes()

    def word(self, raw: bytes) -> bytes:
        """The ids of one word as 32-bit integers."""
        found = self.known.get(raw)
        if found is not None:
            return found
        text = raw.decode(errors="replace")
        stem = text.rstrip(".,;:!?|")
        ids = self.stem(stem) if stem.isalpha() else None
        if ids is None:
            ids = self._whole(text)
        elif stem != text:
            ids += self.word(text[len(stem) :].encode())
        if len(self.known) >= WORD_CACHE:
            self.known.clear()
        self.known[raw] = ids
        return ids

    def stem(self, word: str) -> bytes | None:
        """The ids of letters alone; None if the normalizer makes other characters of them."""
        if word not in self.stems:
            if len(self.stems) >= WORD_CACHE:
                self.stems.clear()
            self.stems[word] = self._letters(word)
        return self.stems[word]

    def ids(self, text: bytes) -> np.ndarray:
        known, word = self.known.get, self.word
        return np.frombuffer(b"".join([known(w) or word(w) for w in text.split()]), dtype="<u4")


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def write_records(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every whole text and write its ids, end_id appended, to record files in ascending doc_id order (nulls first).

    Returns the offset index, one row per record: path, part, position, doc_id, offset, bytes, n_tokens. Texts are dealt by ranges of doc_id and a hash of the text
    and sorted in each; a range is tokenized and written by one task, so the ids themselves are never shuffled. The number of ranges grows with the texts, and
    rows that share an id (or have none) are dealt over several where they are many; only rows that repeat id and text stay together.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_file)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")

        def write(out) -> list[tuple]:
            rows, offset = [], 0
            for batch in whole:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = np.concatenate([tokenizer.ids(text.as_py() or b""), end])
                    record = frame(pack_ids(doc, ids))
                    out.write(record)
                    rows.append((len(rows), doc, offset, len(record), len(ids)))
                    offset += len(record)
            return rows

        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        whole = (x for xs in ([head], batches) for x in xs)
        path, rows = commit_file(folder, f"part-{part:06d}.ids", write)
        for i in range(0, len(rows), 50_000):
            some = rows[i : i + 50_000]
            columns = [pa.array(c, pa.int64()) for c in zip(*some, strict=True)]
            yield pa.record_batch([pa.array([path] * len(some)), pa.array([part] * len(some), pa.int64()), *columns], names=["path", "part", "position", "doc_id", "offset", "bytes", "n_tokens"])

    rows = rows.withColumn("_hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")
    schema = "path string, part long, position long, doc_id long, offset long, bytes long, n_tokens long"
    return stash(dealt.mapInArrow(run, schema), "offsets")


def read_records(index: DataFrame) -> DataFrame:
    """(path, offset, doc_id, ids_crc32, n_tokens) per record of the files in the index, read front to back and checked.

    ids_crc32 is the checksum of all ids as little-endian unsigned 32-bit integers. A file is one task; its records pass by
    one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "doc_id", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, offset = [], 0
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None, buffer_size=1 << 20) as source:
                    while (payload := unframe(source)) is not None:
                        doc, ids = unpack_ids(payload)
                        rows.append((offset, doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        offset += len(payload) + _AROUND
                for i in range(0, len(rows), 50_000):
                    some = rows[i : i + 50_000]
                    yield pa.record_batch([pa.array([path] * len(some)), *(pa.array(c, pa.int64()) for c in zip(*some, strict=True))], names=names)

    paths = index.select("path").distinct()
    return paths.repartition(max(1, paths.count())).mapInArrow(run, "path string, offset long, doc_id long, n_tokens long, ids_crc32 long")


def fetch_records(index: DataFrame) -> DataFrame:
    """(doc_id, ids array<long>) for the index rows given, read at their offsets in the order given: a shuffled read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, out = [], []
            opened = source = None
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != opened:
                    if source is not None:
                        source.close()
                    fs, at = pyarrow.fs.FileSystem.from_uri(path)
                    opened, source = path, fs.open_input_file(at)
                source.seek(offset)
                doc, ids = unpack_ids(unframe(source))
                docs.append(doc)
                out.append(ids.tolist())
            if source is not None:
                source.close()
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return index.select("path", "offset").mapInArrow(run, "doc_id long, ids array<long>")


def token_records(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the corpus as record files and read them back: doc_id, start, n_tokens, ids_crc32 per document.

    start counts the ids of all documents before it: a running sum within its file plus the sum of the files before. Null and
    empty texts hold the end id only. Null doc_ids come first; rows of equal doc_id stand in order of the text's (signed) XXH64
    of seed 42, then of the text. Texts of any length are encoded whole. Rows that repeat count separately. Other columns are ignored. An empty table writes no file and gives none.
    """
    index = write_records(docs, folder or scratch(docs.sparkSession, "ids"), tokenizer_file, end_id, id_col, text_col)
    files = index.groupBy("path", "part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = stash(files.select("path", before.alias("base")), "bases")
    upto = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    read = read_records(index).withColumn("within", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)))
    return read.join(bases, "path").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
