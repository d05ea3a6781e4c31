"""Two tokenizers' tokens of a text side by side: groups that cover the same bytes, links of tokens that overlap, and how often ids are linked in the whole corpus."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import join_hot, stash

#: Tokens of either side that are aligned at once; longer texts are cut where tokens of both sides end.
TOKENS = 1 << 18
#: A block of documents ends after half as many distinct pairs.
PAIRS = 1 << 20
#: Longer texts go to the piece tokenizer in pieces of about so many characters.
PIECE = 1 << 15
# The pre-splitting pattern that the ByteLevel step of tokenizer files stands for, the mark for a space in pieces, and the form of pieces that are bytes.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK, BYTE_PIECE = "▁", re.compile("<0x([0-9A-F]{2})>")
#: A pair of ids as one number.
_SHIFT = 32


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for themselves, all others by the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Fast(bpe.Encoder):
    """A byte-level vocabulary whose ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.split, self.whole = (tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) for pattern in (BYTE_LEVEL, r"[\s\S]+"))


class ByteLevelTokenizer:
    """A byte-level BPE file of the tokenizers library: the ids of a text and the bytes of an id; special tokens' strings are plain text.

    Where the file's ids follow its merges and nothing else changes the text, the tiktoken library gives the same ids several times as fast; texts beyond Latin-1, whose characters the libraries'
    versions of Unicode might class differently, and all other files take the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        known, alphabet = self.full.get_vocab(with_added_tokens=True), byte_alphabet()
        self.bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        first = {**(spec["pre_tokenizer"] or {})}
        first.pop("trim_offsets", None)
        same = first == plain and not spec["normalizer"] and not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        ordered = len(vocab) == 256 + len(pairs) and all(vocab.get(token) == 256 + i for i, token in enumerate(pairs)) and {t for t, i in vocab.items() if i < 256} == set(alphabet)
        self.fast = _Fast({self.bytes[i]: i for i in vocab.values()}) if same and ordered else None

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return self.fast.encode(text)
        return self.full.encode(text, add_special_tokens=False).ids


class PieceTokenizer:
    """A sentencepiece file: the ids of a text and the bytes of an id.

    If no piece goes on from another character to a space, no merge reaches over the beginning of a space, so long texts are encoded in pieces that begin with one, which is then the one that the library adds.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.full = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.full.id_to_piece(i) for i in range(self.full.get_piece_size())]
        self.bytes = [bytes([int(BYTE_PIECE.fullmatch(p)[1], 16)]) if self.full.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)

    def encode(self, text: str) -> list[int]:
        if not self.cuts or len(text) <= PIECE:
            return self.full.encode(text)
        ids, start = [], 0
        while start < len(text):
            cut = _WORD_END.search(text, start + PIECE)
            end = cut.start() if cut else len(text)
            ids += self.full.encode(text[start:end])
            if not cut:
                break
            start = end + 1  # the space that the library adds to what follows
            if start == len(text):
                ids.append(self.full.piece_to_id(MARK))
        return ids


#: A space after another character.
_WORD_END = re.compile("(?<=[^ ▁]) ")


@functools.lru_cache(maxsize=4)
def byte_tokenizer(path: str) -> ByteLevelTokenizer:
    return ByteLevelTokenizer(path)


@functools.lru_cache(maxsize=4)
def piece_tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def both_sides(text: bytes | None, a: ByteLevelTokenizer, b: PieceTokenizer) -> tuple[np.ndarray, np.ndarray]:
    """The ids of either side; none if the text is null, empty or not UTF-8, or if the tokens of one side don't spell space and text."""
    none = np.empty(0, dtype=np.int64)
    if not text:
        return none, none
    try:
        decoded = text.decode()
    except UnicodeDecodeError:
        return none, none
    left, right = a.encode(" " + decoded), b.encode(decoded)
    for ids, table in ((left, a.bytes), (right, b.bytes)):
        if b"".join([table[i] for i in ids]) != b" " + text:
            return none, none
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


class Aligner:
    """Aligns the tokens of several documents at once. sizes_a and sizes_b are the bytes of an id."""

    def __init__(self, a: ByteLevelTokenizer, b: PieceTokenizer):
        self.sizes = [np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (a, b)]
        ends = ((",", "|"), (",", ";"))
        self.names = [f"{i}{end}".encode() for t, pair in zip((a, b), ends, strict=True) for end in pair for i in range(len(t.bytes))]
        self.offsets = [(0, len(a.bytes)), (2 * len(a.bytes), 2 * len(a.bytes) + len(b.bytes))]

    def spell(self, left: np.ndarray, right: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """The groups as text, each closed by ';': last_a and last_b are the places of the last tokens of every group."""
        before_b, before_a = np.r_[0, last_b[:-1] + 1], last_a + 1
        out = np.empty(len(left) + len(right), dtype=np.int64)
        sizes_a, sizes_b = np.diff(np.r_[0, last_a + 1]), np.diff(np.r_[0, last_b + 1])
        for ids, last, shift, (inner, closing) in ((left, last_a, np.repeat(before_b, sizes_a), self.offsets[0]), (right, last_b, np.repeat(before_a, sizes_b), self.offsets[1])):
            codes = ids + inner
            codes[last] += closing - inner
            out[np.arange(len(ids)) + shift] = codes
        return b"".join([self.names[c] for c in out.tolist()])

    def links(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(place in docs, pair of ids) of every overlap of an A token with a B token: each token's start finds the other side's covering token, in both directions."""
        sides = []
        for side in (0, 1):
            ids = [d[side] for d in docs]
            lengths = np.array([len(x) for x in ids])
            flat = np.concatenate([np.empty(0, dtype=np.int64), *ids])
            # starts grow over the whole batch, so that they are sorted, but only tokens of one document are matched
            start = np.cumsum(self.sizes[side][flat]) - self.sizes[side][flat]
            sides.append(pd.DataFrame({"doc": np.repeat(np.arange(len(docs)), lengths), "start": start, "from": start, "id": flat}))
        a, b = sides
        of_a = pd.merge_asof(a, b, on="start", by="doc", suffixes=("_a", "_b"))
        of_b = pd.merge_asof(b, a, on="start", by="doc", suffixes=("_b", "_a"))
        of_b = of_b[of_b["from_a"] != of_b["from_b"]]  # tokens that start together have met already
        doc = np.concatenate([of_a["doc"].to_numpy(), of_b["doc"].to_numpy()])
        pair = np.concatenate([(t["id_a"].to_numpy(dtype=np.int64) << _SHIFT) | t["id_b"].to_numpy(dtype=np.int64) for t in (of_a, of_b)])
        return doc, pair


def _group_ends(left: np.ndarray, right: np.ndarray, sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the tokens of either side that end where one of the other side ends."""
    ends = [np.cumsum(s[ids]) for s, ids in zip(sizes, (left, right), strict=True)]
    _, last_a, last_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
    return last_a, last_b


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
    return keys[first], np.add.reduceat(counts, first)


_ROW = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document a row (block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) with its distinct pairs of linked ids and how often each is; and a row with no n_a per block, with the sums of its documents.

    A block is a run of documents of one task that ends at about PAIRS / 2 distinct pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_tokenizer(byte_file), piece_tokenizer(piece_file)
        aligner = Aligner(a, b)
        task, blocks = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray, np.ndarray]] = []
        tokens, sums = 0, [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]

        def rows(columns: list, lists: list[list[np.ndarray]]) -> pa.RecordBatch:
            arrays = [pa.array([task << 32 | blocks] * len(columns[0]), pa.int64()), *(pa.array(c, pa.string() if i == 5 else pa.int64()) for i, c in enumerate(columns))]
            for values in lists:
                offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *values]))))
            return pa.record_batch(arrays, names=[c.split()[0] for c in _ROW.split(", ")])

        def flush() -> pa.RecordBatch:
            """The documents held, aligned; long ones in stretches."""
            stretches, owner, figures = [], [], []
            for place, (doc, left, right) in enumerate(held):
                last_a, last_b = _group_ends(left, right, aligner.sizes)
                digest = hashlib.sha256(aligner.spell(left, right, last_a, last_b)[:-1]).hexdigest() if len(left) else ""
                figures.append((doc, len(left), len(right), len(last_a), digest))
                cuts = np.searchsorted(last_a, np.arange(TOKENS, len(left), TOKENS))
                cuts = np.unique(np.r_[cuts[cuts < len(last_a)], len(last_a) - 1]) if len(last_a) else []
                from_a = from_b = 0
                for c in cuts:
                    stretches.append((left[from_a : last_a[c] + 1], right[from_b : last_b[c] + 1]))
                    owner.append(place)
                    from_a, from_b = last_a[c] + 1, last_b[c] + 1
            parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in held]
            n_links = np.zeros(len(held), dtype=np.int64)
            at = 0
            while at < len(stretches):
                to, some = at, 0
                while to < len(stretches) and (to == at or some + len(stretches[to][0]) <= TOKENS):
                    some += len(stretches[to][0])
                    to += 1
                doc, pair = aligner.links(stretches[at:to])
                order = np.lexsort((pair, doc))
                doc, pair = doc[order], pair[order]
                first = np.r_[0, np.flatnonzero((doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])) + 1]
                times = np.diff(np.r_[first, len(doc)])
                bounds = np.searchsorted(doc[first], np.arange(to - at + 1))
                for i in range(to - at):
                    s = slice(bounds[i], bounds[i + 1])
                    parts[owner[at + i]].append((pair[first[s]], times[s]))
                    n_links[owner[at + i]] += times[s].sum()
                at = to
            own = [p[0] if len(p) == 1 else _merged(*(np.concatenate([np.empty(0, dtype=np.int64), *c]) for c in zip(*p, strict=True))) if p else sums[0] for p in parts]
            sums.append(_merged(np.concatenate([p for p, _ in own]), np.concatenate([t for _, t in own])))
            docs, n_a, n_b, n_groups, digests = zip(*figures, strict=True)
            return rows([docs, n_a, n_b, n_groups, n_links, digests], [[p for p, _ in own], [t for _, t in own]])

        def end_block() -> pa.RecordBatch:
            pairs, times = _merged(*(np.concatenate(c) for c in zip(*sums, strict=True)))
            return rows([[None]] * 6, [[pairs], [times]])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                left, right = both_sides(text.as_py(), a, b)
                held.append((doc, left, right))
                tokens += len(left)
                if tokens >= TOKENS or len(held) >= 10_000:
                    yield flush()
                    held, tokens = [], 0
                    if sum(len(p) for p, _ in sums) >= PAIRS:
                        sums = [sums[0], _merged(*(np.concatenate(c) for c in zip(*sums, strict=True)))]
                        if 2 * len(sums[1][0]) >= PAIRS:
                            yield end_block()
                            sums, blocks = sums[:1], blocks + 1
        if held:
            yield flush()
        yield end_block()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, _ROW)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(block, pair, count, best) for the blocks of align(): how many links of the whole corpus join the pair of ids, and whether no A id is linked more often with that B id.

    Sums of blocks are added up by pair, not links; a B id has at most as many pairs as side A has ids. Pairs of very many blocks are joined in parts.
    """
    parts = aligned.where("n_a IS NULL").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    totals = parts.groupBy("pair").agg(F.sum("times").alias("count"), F.count("*").alias("n"))
    per_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << _SHIFT) - 1))
    totals = stash(totals.withColumn("best", F.col("count") == F.max("count").over(per_b)), "counts")
    return join_hot(parts.select("block", "pair"), totals, "pair", "block").select("block", "pair", "count", "best")


def _weigh(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Every document's sums over its links: the counts of a block come first and are held, its documents pass by."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, table = None, [], None
        for batch in batches:
            blocks, is_doc = batch.column(0).to_numpy(), np.asarray(batch.column(1).is_valid())
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(blocks)], strict=True):
                if s == e:
                    continue
                if blocks[s] != block:
                    block, held, table = blocks[s], [], None
                rows = batch.slice(s, e - s)
                if not is_doc[s]:
                    held.append([rows.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6)])
                    continue
                if table is None:
                    table = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.empty(0, dtype=np.int64)] * 3
                    held = []
                pair, count, best = table
                pairs, times = (rows.column(i).flatten().to_numpy() for i in (2, 3))
                bounds = np.asarray(rows.column(2).offsets).astype(np.int64)
                at = np.searchsorted(pair, pairs)
                sums = []
                for each in (times * best[at], times * count[at]):
                    total = np.r_[0, np.cumsum(each, dtype=np.int64)][bounds - bounds[0]]
                    sums.append(pa.array(np.diff(total)))
                doc, n_a, n_b, n_groups, n_links, digest = rows.column(1).flatten()
                yield pa.record_batch([doc, n_a, n_b, n_groups, n_links, *sums, digest], names=names)

    figures = F.struct("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    of_docs = aligned.where("n_a IS NOT NULL").select("block", figures.alias("figures"), "pairs", "times")
    rows = of_docs.unionByName(counts, allowMissingColumns=True).select("block", "figures", "pairs", "times", "pair", "count", "best")
    dealt = rows.repartition("block").sortWithinPartitions("block", F.col("figures").isNotNull(), "pair")
    return dealt.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def token_alignment(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens A come from a byte-level file of the tokenizers library on space and text, tokens B from a sentencepiece file on the text, to which it adds the space; neither has special tokens.
    Where tokens of both end they cut a group; tokens that share a byte are linked. count_sum adds up, over a document's links, how many links of the corpus join the same two ids; n_best counts
    the links whose ids are joined as often as that B id is with any. groups_sha256 is the digest of the groups' ids.
    A block of documents shares one table of the corpus-wide counts of its pairs, so pairs are shuffled once a block, and a pair that all texts hold is one row in each. Texts that are null, empty, not UTF-8, or
    that either side spells otherwise have zeros and an empty digest. Texts of any length are encoded whole and aligned in stretches between common ends.
    Ties for the highest count are all best. Rows that repeat count separately, and rows without an id are kept. Other columns are ignored. An empty table gives none.
    """
    aligned = stash(align(docs, byte_file, piece_file, id_col, text_col), "aligned")
    return _weigh(aligned, pair_counts(aligned))
