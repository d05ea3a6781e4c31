"""SimHash near-duplicates found by covering locality-sensitive hashing."""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_hot, least_of, roots, stars, stash

SEED = 42
BITS = 64
#: Members of a bucket that are compared in one block; larger buckets are split into pairs of blocks.
BLOCK = 1024
#: In buckets of at most so many members all pairs are compared, many buckets in one step.
SMALL = 64
#: The sizes of buckets are estimated from one in so many members. They only decide how a bucket is split.
SAMPLE = 16


def shingle_hashes(text: str | bytes | None, shingle: int) -> np.ndarray:
    """The XXH64 values (seed 42) of the text's word shingles, repeats included.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A text of fewer words than a shingle is one
    shingle; one without words (or null) has none.
    """
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(run), SEED) for run in runs], dtype=np.uint64)


def counts(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of hashes (rows, words)."""
    ones = np.zeros(hashes.shape[1] * BITS, dtype=np.int64)
    flat = np.ascontiguousarray(hashes).astype("<u8", copy=False).view(np.uint8).reshape(len(hashes), -1)
    for i in range(0, len(flat), 255):  # as many as a byte can count
        ones += np.unpackbits(flat[i : i + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return ones


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """SimHash of the text's word shingles: bit k is 1 if set in over half of their XXH64 values; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    return int(np.packbits(2 * counts(hashes[:, None]) > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint: 64 bits as bigint) per row; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(values)], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, "doc_id long, fingerprint long")


def covering_masks(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """The 2**(radius+1) - 1 masks over so many bits of a covering code.

    Every bit gets a non-zero label of radius + 1 bits; mask v keeps the bits whose label has odd overlap with v. Any
    radius differing bits leave at least one v that is orthogonal to all their labels, so two fingerprints within the
    radius agree on all bits of some mask. Labels are dealt evenly, so that masks keep about half of the bits.
    """
    labels = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    if 2 ** (radius + 1) - 1 > bits:
        labels = random.Random(seed).sample(range(1, 2 ** (radius + 1)), bits)
    return [sum(1 << i for i, label in enumerate(labels) if (label & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def differing_share(similarity: float) -> float:
    """The expected share of differing bits of two shingle sets of that Jaccard similarity and equal size (at most that, if sizes differ)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@functools.cache
def covering_plan(count: int, similarity: float, miss: float) -> tuple[int, int, int]:
    """(words, bits, radius): how many fingerprints of how many bits, covered up to which radius, for so many documents.

    Masks keep about log2(count) - 4 bits, so a bucket holds about sixteen unrelated documents whatever the count. Pairs within the radius in any
    of the fingerprints always meet, and so do many beyond it. As many fingerprints are taken as leave at most the share miss of the pairs at that
    similarity without a common bucket, at every count; of all radii the one with the fewest masks in all is chosen.
    """
    bits = 2 * min(max(math.ceil(math.log2(max(count, 2))) - 4, 10), BITS // 2)
    drawn = np.random.default_rng(SEED).random((20_000, bits)) < differing_share(similarity)
    differ = (drawn * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    best = (math.inf, 0, 0)
    for radius in range(1, 8):
        masks = np.array(covering_masks(radius, bits), dtype=np.uint64)
        meet = (differ[:, None] & masks == 0).any(axis=1).mean()
        words = math.ceil(math.log(miss) / math.log1p(-meet))
        best = min(best, (words * len(masks), words, radius))
    return best[1], bits, best[2]


def _links(values: np.ndarray, most: int, split: int | None = None) -> Iterator[tuple[int, int]]:
    """Edges between positions that connect exactly what pairs of at most most differing bits connect (between values[:split] and values[split:] if given).

    Each value looks once at the values that nothing has reached yet, so there are fewer edges than values, and all is done once
    everything has been reached.
    """
    rest = np.arange(len(values))
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(values[rest] ^ values[at]).sum(axis=1) <= most
            if split is not None:
                near &= (rest >= split) != (at >= split)
            found = rest[near].tolist()
            if found:
                rest = rest[~near]
                todo.extend(found)
                for other in found:
                    yield at, other


def _linked(values: np.ndarray, most: int, split: int | None = None) -> np.ndarray:
    return np.array(list(_links(values, most, split)), dtype=np.int64).reshape(-1, 2).T


def _across(nodes: np.ndarray, values: np.ndarray, split: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """What near pairs across two blocks connect, as edges between the smallest nodes of what is connected in either block alone: there each
    block's own task joins the others to these. Two blocks of copies of one text come to one edge."""
    within = np.concatenate([_linked(values[:split], most), split + _linked(values[split:], most)], axis=1)
    order = np.argsort(nodes, kind="stable")
    rank = np.argsort(order)
    least = nodes[order[roots(len(nodes), rank[within[0]], rank[within[1]])]][rank]
    return tuple(np.unique(least[_linked(values, most, split)], axis=1))


def _linker(most: int):
    """For rows (bucket, i, j, block, node, words of the fingerprint...) sorted by bucket, i, j, block: the edges within each (bucket, i, j)."""

    def edges(keys: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (keys[1:, :3] != keys[:-1, :3]).any(axis=1)]
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        ends = np.r_[starts[1:], len(keys)]
        small = (ends - starts <= SMALL)[group]
        pairs = [np.empty((2, 0), dtype=np.int64)]
        for step in range(1, SMALL):
            at = np.flatnonzero(small[step:] & (group[step:] == group[:-step]))
            if not len(at):
                break
            at = at[(keys[at, 1] == keys[at, 2]) | (keys[at, 3] != keys[at + step, 3])]
            at = at[np.bitwise_count(values[at] ^ values[at + step]).sum(axis=1) <= most]
            pairs.append(np.stack([at, at + step]))
        near = np.concatenate(pairs, axis=1)
        dense = (ends - starts > SMALL) | (np.bincount(group[near[0]], minlength=len(starts)) > ends - starts)
        pairs, found = [near[:, ~dense[group[near[0]]]]], []
        for s, e in zip(starts[dense], ends[dense], strict=True):
            if keys[s, 1] == keys[s, 2]:
                pairs.append(s + _linked(values[s:e], most))
            else:
                found.append(_across(nodes[s:e], values[s:e], int((keys[s:e, 3] == keys[s, 1]).sum()), most))
        u, v = np.concatenate([stars(nodes, *np.concatenate(pairs, axis=1)), *found], axis=1)
        return pa.record_batch([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5, batch.num_columns)], axis=1).view(np.uint64)
            now = (keys, batch.column(4).to_numpy(zero_copy_only=False), values)
            now = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            last = np.flatnonzero((now[0][:, :3] != now[0][-1, :3]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield edges(*(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
        if held is not None and len(held[0]):
            yield edges(*held)

    return run


def links(values: DataFrame, tables: list[tuple[int, int]], compared: list[int], most: int, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between the names of values(node, name, fingerprint array<bigint>), one row a node, that connect near ones; without a column name a node is its own name.

    tables are (word, mask): every value goes to one bucket for each, that of the word's bits under the mask. Two values in a bucket are near if they
    differ in at most most bits of the compared words, which travel with the node, so nothing is joined back.

    Large buckets are split into blocks whose pairs are separate tasks. A bucket yields fewer edges in each
    task than it has members there, however many pairs are near: each member is joined to the smallest it is connected with.
    """
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fingerprint")[word].bitwiseAND(F.lit(signed(mask)).cast("long"))) for t, (word, mask) in enumerate(tables)])
    sampled = values.where(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(SAMPLE)) == 0).select(F.explode(keys).alias("bucket"))
    large = sampled.groupBy("bucket").agg((F.count("*") * SAMPLE).alias("n")).where(F.col("n") > block)
    large = stash(large.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    values = values if "name" in values.columns else values.withColumn("name", F.col("node"))
    rows = values.select("node", "name", *[F.col("fingerprint")[w].alias(f"word{w}") for w in compared], F.explode(keys).alias("bucket"))
    rows = rows.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "name", *[f"word{w}" for w in compared])
    return tasks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block").mapInArrow(_linker(most), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (64 bits as bigint), component_id.

    Fingerprints that differ in at most radius bits are linked: such pairs always meet under a covering mask. component_id is the smallest non-null
    doc_id reachable, itself included. Copies share a fingerprint and are merged before any comparison. Null or wordless texts have
    fingerprint 0 and are linked like any other. All shingles of texts of any length count, in bounded blocks. Rows that repeat have one component. Other columns are ignored. An empty table gives none.
    """
    rows = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    values = stash(rows.groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "values")
    edges = links(values.select("node", F.array("node").alias("fingerprint")), [(0, m) for m in covering_masks(radius)], [0], radius)
    label = stash(components(edges), "components")
    linked = least_of(values.drop("n").join(label, "node"), "component", "first_id", "node", "component_id").select("node", F.col("component_id").alias("_least"))
    found = stash(values.join(linked, "node", "left").select(F.col("node").alias("fingerprint"), F.coalesce("_least", "first_id").alias("component_id"), "n"), "found")
    return join_hot(rows, found, "fingerprint", "doc_id").select("doc_id", "fingerprint", "component_id")
