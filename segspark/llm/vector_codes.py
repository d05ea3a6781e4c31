"""Vectors as short codes: product codebooks in whole numbers, whose products are exact in float64 because integers are cut into limbs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, stash

#: Components are taken in units of 1 / SCALE.
SCALE = 1024
#: Equal parts of a vector, entries of each part's codebook, and rounds of assigning and averaging.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors whose distances are worked out at once.
ROWS = 2048


def whole_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str, *others: Column) -> DataFrame:
    """(vec_id, x, others) with the components of x as floor(scale * component); vectors that are null or hold null or non-finite components go."""
    x = F.col(vector_col).cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.where(F.coalesce(sound, F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("x"), *others)


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list array as rows; shorter ones end in zeros."""
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy()
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def limb_bits(dim: int) -> int:
    """So many bits a limb that dim products of two limbs sum to at most 2 ** 53."""
    return (53 - max(dim - 1, 0).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Limbs in float64 whose sum, each shifted by bits more than the one before, is x; only the last is signed."""
    out = []
    while len(x) and max(int(x.max()), -int(x.min())) > 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner products of the rows of x with those of y in int64: float64 products of limbs, each exact, added up in whole numbers.

    Exact if the inner products themselves fit 63 bits; sums on the way may wrap around without harm.
    """
    bits = limb_bits(x.shape[1])
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    right = limbs(y, bits) if y.size else [y.astype(np.float64)]
    for i, a in enumerate(limbs(x, bits) if x.size else [x.astype(np.float64)]):
        for j, b in enumerate(right):
            if bits * (i + j) < 64:
                out += (a @ b.T).astype(np.int64) << np.int64(bits * (i + j))
    return out


class Codebook:
    """entries: (parts, entries, length) in int64."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.norms = [(e * e).sum(axis=1) for e in entries]
        self.largest = max(int(entries.max(initial=0)), -int(entries.min(initial=0)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the rows of x: (rows, parts) of the nearest entries, the first of equal ones, and the squared distances to these."""
        parts, _, length = self.entries.shape
        largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if parts * max(length, 1) * (largest + self.largest) ** 2 >= 1 << 63:
            raise OverflowError("squared distances of these vectors don't fit 63 bits")
        codes, errors = np.empty((len(x), parts), dtype=np.int64), np.empty((len(x), parts), dtype=np.int64)
        for p in range(parts):
            own = np.ascontiguousarray(x[:, p * length : (p + 1) * length])
            distances = self.norms[p] - 2 * exact_products(own, self.entries[p])
            codes[:, p] = distances.argmin(axis=1)
            errors[:, p] = distances[np.arange(len(x)), codes[:, p]] + (own * own).sum(axis=1)
        return codes, errors

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _blocks(lists: pa.Array, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(lists), ROWS):
        yield at, matrix(lists.slice(at, ROWS), dim)


def _totals(kept: DataFrame, codebook: Codebook, dim: int) -> dict[tuple[int, int, int], int]:
    """(part, entry, k) -> the sum of component k over the parts that are nearest to the entry, and how many these are at k = -1.

    Every task adds up its own vectors, so entries x dim rows a task are shuffled and entries x dim reach the driver, however many vectors there are.
    """
    parts, entries, length = codebook.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, length), dtype=np.int64)
        for batch in batches:
            for _, x in _blocks(batch.column(0), dim):
                codes, _ = codebook.nearest(x)
                for p in range(parts):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, first = np.unique(codes[order, p], return_index=True)
                    count[p] += np.bincount(codes[:, p], minlength=entries)
                    total[p, used] += np.add.reduceat(x[order, p * length : (p + 1) * length], first, axis=0)
        part, entry = np.nonzero(count)
        sums = np.concatenate([count[part, entry, None], total[part, entry]], axis=1)
        keys = [np.repeat(part, length + 1), np.repeat(entry, length + 1), np.tile(np.arange(-1, length), len(part)), sums.ravel()]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in keys], names=["part", "entry", "k", "total"])

    sums = kept.select("x").mapInArrow(run, "part long, entry long, k long, total long").groupBy("part", "entry", "k").agg(F.sum("total").alias("total"))
    return {(r.part, r.entry, r.k): r.total for r in sums.collect()}


def fit(kept: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebook:
    """The codebook of kept(vec_id, x): it starts as the vectors of the smallest vec_ids (fewer than entries if there are fewer) and moves to the floors of the means of what is nearest; unused entries stay."""
    length = dim // parts
    seeds = kept.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    start = matrix(pa.array([r.x for r in seeds], pa.list_(pa.int64())), dim)
    book = Codebook(np.stack([start[:, p * length : (p + 1) * length] for p in range(parts)]))
    for _ in range(rounds):
        totals, moved = _totals(kept, book, dim), book.entries.copy()
        for (part, entry, k), total in totals.items():
            if k >= 0:
                moved[part, entry, k] = total // totals[part, entry, -1]
        book = Codebook(moved)
    return book


def encode(kept: DataFrame, book: Codebook, dim: int) -> DataFrame:
    """kept(vec_id, x, ...) with code (two hex digits a part) and error in place of x."""
    others = [c for c in kept.columns if c != "x"]
    width = max(2, len(f"{max(book.entries.shape[1] - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for _, x in _blocks(batch.column(len(others)), dim):
                nearest, squared = book.nearest(x)
                codes += ["".join(f"{c:0{width}x}" for c in row) for row in nearest.tolist()]
                errors.append(squared.sum(axis=1))
            columns = [*batch.columns[: len(others)], pa.array(codes, pa.string()), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *errors]))]
            yield pa.record_batch(columns, names=[*others, "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.select(*others, "x").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "code string", "error long"]))


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: vec_id, code, error, label_error, codebooks_sha256.

    A vector's components, in whole units of 1 / scale, are cut into equal parts, and each part is named by its nearest codebook entry (see
    fit()). error is the squared distance from vector to code, label_error its sum over the rows of an equal label, nulls together.
    Vectors that are null or hold null or non-finite components go. Shorter vectors end in zeros, and so do all whose length the number of parts doesn't divide;
    texts play no part. Equal distances go to the lower index. Rows that repeat count separately; rows without an id
    seed last. Distances beyond 63 bits raise OverflowError. Other columns are ignored. An empty table gives none.
    """
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("")).alias("label")
    kept = stash(whole_vectors(rows, scale, id_col, vector_col, label), "vectors")
    longest = kept.agg(F.max(F.size("x"))).first()[0]
    dim = parts * max(1, -(-(longest or 0) // parts))
    if longest is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    book = fit(kept, dim, parts, entries, rounds)
    coded = stash(encode(kept, book, dim), "codes")
    discard(kept)
    sums = stash(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    return join_hot(coded, sums, "label", "vec_id").select("vec_id", "code", "error", "label_error", F.lit(book.sha256()).alias("codebooks_sha256"))
