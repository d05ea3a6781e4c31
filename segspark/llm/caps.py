"""Near-duplicate vectors by spherical-cap filters of structured random product codes."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, join_hot, roots, stash

#: Unrelated vectors that an average filter holds. It sets the share of vectors that a filter takes, whatever their number.
MEMBERS = 8
#: Share of the pairs at the threshold that may have no common filter.
MISS = 0.005
#: Vectors of a filter that are compared in one block.
BLOCK = 1024
#: The sizes of filters are estimated from one in so many vectors. They only decide how a filter is split.
SAMPLE = 16
#: Shorter vectors are padded with zeros, which changes no angle.
LEAST_DIM = 16


class ProductCode:
    """Filter directions that join a random codeword for either half of a randomly rotated vector.

    A vector belongs to the directions within a spherical cap around it: those whose inner product with it exceeds the level, which is one for
    all vectors. A direction's number spells its two codewords.
    """

    def __init__(self, dim: int, words: int, level: float, seed: int):
        rng = np.random.default_rng([11, dim, seed])
        wide = max(dim, LEAST_DIM)
        self.rotation = np.linalg.qr(rng.normal(size=(wide, wide)))[0][:dim]
        self.half, self.words, self.level = wide // 2, words, level
        self.code = []
        for size in (self.half, wide - self.half):
            code = rng.normal(size=(words, size))
            self.code.append(code / np.linalg.norm(code, axis=1, keepdims=True))

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x @ self.rotation
        return y[:, : self.half] @ self.code[0].T, y[:, self.half :] @ self.code[1].T

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of all directions that exceed the level: only codewords that can reach it with the best of the other half are joined."""
        a, b = self.scores(x)
        row_a, i = np.nonzero(a >= self.level - b.max(axis=1, keepdims=True))
        row_b, j = np.nonzero(b >= self.level - a.max(axis=1, keepdims=True))
        many = np.bincount(row_b, minlength=len(x))
        times = many[row_a]
        left = np.repeat(np.arange(len(row_a)), times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + (np.cumsum(many) - many)[row_a[left]]
        over = a[row_a, i][left] + b[row_b, j][right] >= self.level
        left, right = left[over], right[over]
        return row_a[left], i[left] * self.words + j[right]


@functools.cache
def cap_plan(dim: int, count: int, least: float, miss: float = MISS) -> tuple[int, int, float]:
    """(codes, words, level) for so many vectors: independent product codes, codewords of a half, and the level that directions must exceed.

    The level lets a direction take the share MEMBERS / count of all vectors, and a code has about as many directions as give a vector one of
    them on average. Rotations are random, so any two vectors at the threshold share a direction of a code with the same probability, independently from
    code to code; it is measured on random pairs, and as many codes are taken as leave the share miss of such pairs without any: at every count.
    """
    share = min(MEMBERS / max(count, 1), 1 / 64)
    words, wide = math.ceil(share**-0.5), max(dim, LEAST_DIM)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, wide))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = least * x + math.sqrt(1 - least**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    codes = [ProductCode(wide, words, 0.0, 1000 + k) for k in range(8)]
    best = 256  # codewords of a half that can matter where one direction in all is expected
    tops = [tuple(np.sort(-part, axis=1)[:, :best] for part in code.scores(x)) for code in codes]
    low, high = 0.0, 1.5
    for _ in range(30):
        level = (low + high) / 2
        found = sum(np.searchsorted(b[r], -level - a[r], side="right").sum() for a, b in tops for r in range(0, len(x), 4))
        low, high = (level, high) if found > share * words**2 * len(codes) * len(x) / 4 else (low, level)
    met = 0
    for code in codes:
        code.level = low
        mine, theirs = (row * words**2 + direction for row, direction in map(code.decode, (x, y)))
        met += len(np.unique(np.intersect1d(mine, theirs, assume_unique=True) // words**2))
    return math.ceil(math.log(miss) / math.log1p(-met / len(codes) / len(x))), words, low


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Decoder:
    """All codes of a plan for vectors of one length."""

    def __init__(self, dim: int, plan: tuple[int, int, float]):
        codes, self.words, level = plan
        self.codes = [ProductCode(dim, self.words, level, seed) for seed in range(codes)]

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The sorted numbers of each row's filters."""
        rows, filters = zip(*(code.decode(x) for code in self.codes), strict=True)
        rows, filters = np.concatenate(rows), np.concatenate([f + k * self.words**2 for k, f in enumerate(filters)])
        order = np.lexsort((filters, rows))
        return np.split(filters[order], np.cumsum(np.bincount(rows, minlength=len(x)))[:-1])


def _decoder(plans: dict[int, tuple[int, int, float]], wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoders: dict[int, Decoder] = {}
        for batch in batches:
            vectors = batch.column(2)
            dims = np.diff(vectors.offsets.to_numpy())
            lists: list = [None] * batch.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in decoders:
                    decoders[dim] = Decoder(dim, plans[dim])
                x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                for start in range(0, len(at), 256):
                    for i, found in zip(at[start : start + 256], decoders[dim].decode(unit(x[start : start + 256])), strict=True):
                        lists[i] = found
            yield pa.record_batch([*batch.columns, pa.array(lists, pa.list_(pa.int64() if wide else pa.int32())), pa.array(dims.astype(np.int32))], names=["id", "size", "vector", "filters", "dim"])

    return run


def _first_shared(earlier: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of members of a filter: whether they share no earlier one."""
    if len(i) <= 64:
        return np.array([not np.intersect1d(earlier[a], earlier[b], assume_unique=True).size for a, b in zip(i, j, strict=True)], dtype=bool)
    names, at = np.unique(np.concatenate(earlier), return_inverse=True)
    if not len(names):
        return np.ones(len(i), dtype=bool)
    who = np.repeat(np.arange(len(earlier)), [len(x) for x in earlier])
    shared = np.zeros((len(earlier), len(earlier)), dtype=np.float32)
    for start in range(0, len(names), 4096):
        some = (at >= start) & (at < start + 4096)
        member = np.zeros((len(earlier), min(4096, len(names) - start)), dtype=np.float32)
        member[who[some], at[some] - start] = 1
        shared += member @ member.T
    return shared[i, j] == 0


def _verifier(least: float):
    """For rows (dim, filter, i, j, block, id, size, vector, earlier) sorted by the first four: one row (id, n, root) for each member with a near one.

    n adds up the sizes of the near members, each pair counted in the first filter that both share; root is the member of the smallest
    place that it is connected to.
    """

    def members(rows: pa.Table, across: bool) -> list:
        ids, sizes, block = (rows[c].to_numpy() for c in ("id", "size", "block"))
        vectors = rows["vector"].combine_chunks()
        x = unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
        if across:
            i, j = i[block[i] != block[j]], j[block[i] != block[j]]
        if not len(i):
            return []
        lists = rows["earlier"].combine_chunks()
        first = _first_shared(np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets.to_numpy()[0]), i, j)
        n = np.zeros(len(ids), dtype=np.int64)
        np.add.at(n, i[first], sizes[j[first]])
        np.add.at(n, j[first], sizes[i[first]])
        touched = np.union1d(i, j)
        return [ids[touched], n[touched], ids[roots(len(ids), i, j)[touched]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([rows[c].to_numpy() for c in ("dim", "filter", "i", "j")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            found = []
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
                if e - s > 1 and (got := members(rows.slice(s, e - s), bool(keys[s, 2] != keys[s, 3]))):
                    found.append(got)
            if found:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["id", "n", "root"])

        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = np.stack([table[c].to_numpy() for c in ("dim", "filter", "i", "j")], axis=1)
            ends = np.flatnonzero((keys != keys[-1]).any(axis=1))
            if held and (keys[0] != np.array([held[-1][c][-1].as_py() for c in ("dim", "filter", "i", "j")])).any():
                yield from done(pa.concat_tables(held))
                held = []
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last group may go on in the next batch
            if cut:
                yield from done(pa.concat_tables([*held, table.slice(0, cut)]))
                held = []
            held.append(table.slice(cut))
        if held:
            yield from done(pa.concat_tables(held))

    return run


def near_counts(vectors: DataFrame, least: float = 0.9, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """(id, n, root) rows for vectors(id, size, vector) of equal length with cosine >= least that share a filter.

    The n of an id add up to the sizes of all that is near it, each near vector counted once; its roots connect it with them. A filter (or pair of
    its blocks) gives at most one row for each member, however many pairs are near. Vectors that share a
    filter are compared in double precision in blocks; filters over the block size are split into pairs of blocks,
    which are separate tasks. No filter and no list is cut short.
    """
    count = vectors.count()
    lengths = vectors.select(F.size("vector")).distinct().collect()  # few by nature
    plans = {dim: cap_plan(dim, count, least, miss) for (dim,) in lengths}
    wide = any(codes * words**2 >= 2**31 for codes, words, _ in plans.values())
    schema = f"id long, size long, vector {dict(vectors.dtypes)['vector']}, filters array<{'long' if wide else 'int'}>, dim int"
    decoded = stash(vectors.select("id", "size", "vector").mapInArrow(_decoder(plans, wide), schema), "filters")
    sampled = decoded.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(SAMPLE)) == 0).select("dim", F.explode("filters").alias("filter"))
    large = sampled.groupBy("dim", "filter").agg((F.count("*") * SAMPLE).alias("n")).where(F.col("n") > block)
    large = stash(large.select("dim", "filter", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    rows = decoded.select("*", F.posexplode("filters").alias("at", "filter")).withColumn("earlier", F.slice("filters", F.lit(1), F.col("at"))).drop("filters", "at")
    rows = rows.join(large, ["dim", "filter"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = rows.select("dim", "filter", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "size", "vector", "earlier")
    tasks = tasks.repartition("dim", "filter", "i", "j").sortWithinPartitions("dim", "filter", "i", "j")
    return tasks.mapInArrow(_verifier(least), "id long, n long, root long")


def near_vectors(rows: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Equal vectors are merged before any comparison and link with each other. Null or zero vectors and those with null or non-finite
    components link with nothing, as do vectors of other lengths and rows without an id: their component is their own id. n_links counts
    the other rows linked directly; component_id is the smallest vec_id reachable. What may be missed is the share MISS of the links at the threshold
    (see cap_plan), fewer above it. Other columns are ignored. An empty table gives none.
    """
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    fit = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    classes = stash(own.where(fit).groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("size")), "classes")
    found = stash(near_counts(classes, least), "near")
    label = components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"node": "id"})
    degree = stash(found.groupBy("id").agg(F.sum("n").alias("more")), "degree")
    named = classes.join(degree, "id", "left").join(label, "id", "left").select(
        "vector", F.col("size").alias("n"), (F.coalesce("more", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    named = stash(named, "named")
    discard(found, degree)
    linked = join_hot(own.where(fit), named, "vector", "vec_id").select("vec_id", "n_links", "component_id")
    alone = own.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
