"""The highest inner products of every query by the threshold algorithm over sorted lists of components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .vector_codes import matrix, whole_vectors

#: Components are taken in units of 1 / SCALE.
SCALE = 256
#: Candidates whose lists are sorted in one block.
BLOCK = 1 << 12
#: Depth of the first round in every list, and how many times deeper each round goes.
DEPTH, DEEPER = 16, 4


class SortedLists:
    """Vectors of whole numbers with, for each component, their order by it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.exact = self.x.astype(np.float64)
        self.seen = np.empty(len(ids), dtype=bool)

    def top(self, query: int, q: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, id) of the k best candidates other than the query's own rows, ties to the smaller id; those below least may be left out.

        Every round reads the lists of all components some rows deeper, from the end that raises the score, and scores what it meets for the first time.
        No candidate that is still unseen scores more than the inner product of q with the values at that depth, so once this is
        below the kth score (or below least) the rest can't change the result. At equality an unseen candidate of a smaller id still could.
        """
        n, dim = self.x.shape
        bound = max(dim, 1) * self.largest * max(int(q.max(initial=0)), -int(q.min(initial=0)))
        if bound >= 1 << 63:
            raise OverflowError("inner products of these vectors don't fit 63 bits")
        x, y = (self.exact, q.astype(np.float64)) if bound < 1 << 53 else (self.x, q)
        used = np.flatnonzero(q)
        up = q[used] > 0
        self.seen[:] = self.ids == query
        best_score, best_id = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at, depth = 0, DEPTH if len(used) else n
        while at < n:
            to = min(depth, n)
            if len(used):
                met = np.zeros(n, dtype=bool)
                met[self.order[n - to : n - at, used[up]]] = True
                met[self.order[at:to, used[~up]]] = True
                fresh = np.flatnonzero(met & ~self.seen)
            else:
                fresh = np.flatnonzero(~self.seen)
            self.seen[fresh] = True
            if len(fresh):
                best_score = np.concatenate([best_score, (x[fresh] @ y).astype(np.int64)])
                best_id = np.concatenate([best_id, self.ids[fresh]])
                chosen = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[chosen], best_id[chosen]
            floors = [v for v in (least, int(best_score[-1]) if len(best_score) == k else None) if v is not None]
            edge = np.where(up, self.x[self.order[n - to, used], used], self.x[self.order[to - 1, used], used])
            if floors and int(q[used] @ edge) < max(floors) or self.seen.all():
                break
            at, depth = to, depth * DEEPER
        return [(s, i) for s, i in zip(best_score.tolist(), best_id.tolist(), strict=True) if least is None or s >= least]


def _search(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of rows(block, query_id, vec_id, x, least): each block's k best candidates (rows without a query_id) of each query in it.

    A block's candidates come first and are held; the queries pass by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, lists = None, [], None
        for batch in batches:
            blocks, is_query = batch.column(0).to_numpy(), np.asarray(batch.column(1).is_valid())
            found: list[tuple[int, int, int]] = []
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(blocks)], strict=True):
                if s == e:
                    continue
                x = matrix(batch.column(3).slice(s, e - s), dim)
                if blocks[s] != block:
                    block, held, lists = blocks[s], [], None
                if not is_query[s]:
                    held.append((batch.column(2).slice(s, e - s).to_numpy(), x))
                    continue
                if lists is None and held:
                    lists = SortedLists(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                if lists is not None:
                    for query, q, least in zip(batch.column(1).slice(s, e - s).to_pylist(), x, batch.column(4).slice(s, e - s).to_pylist(), strict=True):
                        found += [(query, i, score) for score, i in lists.top(query, q, k, least)]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    dealt = rows.select("block", "query_id", "vec_id", "x", "least").repartition("block").sortWithinPartitions("block", F.col("query_id").asc_nulls_first())
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def exact_top(rows: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector whose id is divisible by every, the k other vectors of the highest inner product in whole units of 1 / scale.

    Candidates are dealt into blocks by a hash; the lists of a block are sorted once. Every query first searches the block that it is in itself; the kth score found there
    bounds its search in all other blocks, which stops where the threshold can't reach it, and keeps back what can't matter. Ranks come from a
    window that is limited before the shuffle. Fewer than k others give all. Ties go to the smaller vec_id. Vectors that are null or hold null or non-finite components,
    and rows without an id, take no part; rows that repeat id and vector count once, and an id of several vectors is one query whose own vectors are no candidates. Shorter
    vectors end in zeros; texts play no part. Scores beyond 63 bits raise OverflowError. Other columns are ignored. An empty table gives none.
    """
    whole = whole_vectors(rows, scale, id_col, vector_col).where("vec_id IS NOT NULL").distinct()
    kept = stash(whole, "vectors")
    n, dim = kept.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    blocks = max(1, -(-n // (block or BLOCK)))
    kept = kept.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int"))
    none = F.lit(None).cast("long")
    candidates = kept.select("block", none.alias("query_id"), "vec_id", "x", none.alias("least"))
    queries = kept.where(F.col("vec_id") % every == 0).select("block", F.col("vec_id").alias("query_id"), none.alias("vec_id"), "x", none.alias("least"))
    near = stash(_search(candidates.unionByName(queries), dim, k), "near")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    others = queries.drop("least").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("other <> block")
    others = others.join(kth, "query_id", "left").select(F.col("other").alias("block"), "query_id", "vec_id", "x", "least")
    found = near.unionByName(_search(candidates.unionByName(others), dim, k)) if blocks > 1 else near
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
