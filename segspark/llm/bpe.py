"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer texts are encoded in pieces of about so many characters.
PIECE = 1 << 15
#: A run of so much white space is encoded on its own: the pre-splitting pattern backs up over such runs, and the library gives up on very long ones.
BLANKS = 1 << 12
# The characters of Unicode's White_Space property, which the pattern's \\s stands for.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = re.compile(f"[{WHITE_SPACE}]{{{BLANKS},}}")
#: Between a letter or number and what is neither, the pre-splitting pattern always ends one match and begins another.
_SAFE = re.compile(r"(?<=[^\W_])(?=\W)")


@functools.lru_cache(maxsize=8)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (lines of base64 token and rank), without special tokens."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, piece: int = PIECE) -> Iterator[str]:
    """Cut a text at safe boundaries at least piece characters apart; a text without one stays whole.

    Letters and numbers only ever match as runs of their own, with at most a blank or an apostrophe before them, so no match reaches
    over such a boundary, and what follows it doesn't look back. Pieces encode to what the whole text encodes to.
    """
    start = 0
    while len(text) - start > piece:
        cut = _SAFE.search(text, start + piece)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """The text cut around its long runs of white space; True for what is one match of the pattern.

    A run is one match but for its last character, which may belong to the match that follows; at the end of the text it is one match as it is.
    """
    start = 0
    for run in _BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[start : run.start()], False
        yield text[run.start() : end], True
        start = end
    yield text[start:], False


class Encoder:
    """The rank file's encoding of texts of any length, for pre-splitting patterns that keep letters, numbers, other characters and white space apart."""

    def __init__(self, rank_file: str, pattern: str):
        self.split, self.whole = encoding(rank_file, pattern), encoding(rank_file, r"[\s\S]+")

    def encode(self, text: str | None) -> list[int]:
        """Token ids of the whole text; none for null."""
        ids: list[int] = []
        for stretch, one_match in stretches(text or ""):
            if one_match:
                ids += self.whole.encode_ordinary(stretch)
            else:
                for piece in safe_pieces(stretch):
                    ids += self.split.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.split.decode_bytes(ids)


def tokenize(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) per row. Null and empty texts have no ids; texts of any length and make-up are encoded whole. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Encoder(rank_file, pattern)
        for batch in batches:
            ids = pa.array([bpe.encode(x.as_py()) for x in batch.column(1)], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def detokenize(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary) per row of tokens(doc_id, ids): the raw bytes, which need not be valid UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Encoder(rank_file, pattern)
        for batch in batches:
            out = pa.array([bpe.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())
            yield pa.record_batch([batch.column(0), out], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256 (digests of the ids as little-endian 32-bit integers and of the decoded bytes).

    Map-only: each task encodes a document, decodes its ids and keeps only digests. Null counts as empty. Texts of any length and
    make-up (millions of blanks or letters in a row) are encoded whole. Repeated rows give repeated rows; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Encoder(rank_file, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
