"""Near copies by the similarity of their sets of word shingles: covering SimHash proposes, the sets themselves decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, discard, join_hot, least_of, stars, stash

#: Share of the pairs at the least similarity that may have no common bucket.
MISS = 0.01
#: Fingerprints that candidates are compared by besides, and how many standard deviations beyond the expected difference still pass.
COMPARED, SIGMAS = 2, 4
#: Members of a candidate group that are compared in one block; larger groups are split into pairs of blocks.
BLOCK = 512
#: Shingles of the sets in a block, about; a larger set is in a block with few others.
CELLS = 1 << 22

# Fixed values of the SplitMix64 generator, whose finalizer turns one hash of a shingle into several.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_set(text: str | bytes | None, shingle: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 values of the text's word shingles (see simhash.shingle_hashes); none for null or wordless texts."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit name of the set, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def set_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """So many independent SimHashes of a set of shingles."""
    ones = np.zeros(words * simhash.BITS, dtype=np.int64)
    for i in range(0, len(hashes), 4080):  # a bounded block of a long text
        z = hashes[i : i + 4080, None] + np.arange(1, words + 1, dtype=np.uint64) * _STEP
        z = (z ^ z >> np.uint64(30)) * _MIX[0]
        z = (z ^ z >> np.uint64(27)) * _MIX[1]
        ones += simhash.counts(z ^ z >> np.uint64(31))
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *arrays])))


def sketches(docs: DataFrame, words: int, shingle: int = 5) -> DataFrame:
    """(doc_id, content, node, size, fingerprint) per row of docs(doc_id, text): content is a hash of the text, node names its set, size counts it; a set without shingles has no fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints = [], [], []
            for text in batch.column(2):
                own = shingle_set(text.as_py(), shingle)
                nodes.append(set_id(own))
                sizes.append(len(own))
                prints.append(set_fingerprint(own, words).view(np.int64) if len(own) else None)
            columns = [*batch.columns[:2], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "content", "node", "size", "fingerprint"])

    return docs.select("doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(run, "doc_id long, content long, node long, size long, fingerprint array<long>")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(node, fingerprint, first_id, n, size, content, _id) per node of sketches(): the smallest doc_id, the number of rows, and one text with the smallest id that it has (null first)."""
    one = F.min(F.struct("content", "doc_id")).alias("one")
    found = rows.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("size").alias("size"), one)
    return found.select("node", "fingerprint", "first_id", "n", "size", F.col("one.content").alias("content"), F.col("one.doc_id").alias("_id"))


def candidates(values: DataFrame, plan: tuple[int, int, int], least: float) -> DataFrame:
    """Edges (u, v) that connect the nodes of values(node, fingerprint) which share a covering bucket and whose compared words are near enough for that similarity.

    The tables of the first words go first. What they connect has one name in all others, so large groups of near copies, which meet in every table, are joined in
    the first ones and yield no more edges.
    """
    words, bits, radius = plan
    tables = [(word, mask) for word in range(words) for mask in simhash.covering_masks(radius, bits)]
    share, size = simhash.differing_share(least), COMPARED * simhash.BITS
    most = round(share * size + SIGMAS * (share * (1 - share) * size) ** 0.5)
    compared, first = list(range(words, words + COMPARED)), math.ceil(words / 16) * len(tables) // words
    early = stash(simhash.links(values, tables[:first], compared, most).distinct(), "early")
    named = stash(components(early), "names")
    values = values.join(named, "node", "left").withColumn("name", F.coalesce("component", "node"))
    return early.union(simhash.links(values, tables[first:], compared, most))


def _sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(component, blocks, block, node, shingles) of members(content, _id, n, node, component, blocks, block), read from docs(doc_id, text) again.

    A member's text is found by the hash of its content, so a row is read again once at most, whatever ids repeat or lack. Contents of many rows are joined in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # members of this task: rows that repeat count once
        for batch in batches:
            at, sets = [], []
            for i, (text, node) in enumerate(zip(batch.column(0), batch.column(4).to_pylist(), strict=True)):
                if node in seen:
                    continue
                own = shingle_set(text.as_py(), shingle)
                if set_id(own) == node:  # another text of the same hash otherwise
                    seen.add(node)
                    at.append(i)
                    sets.append(own.view(np.int64))
            kept = batch.take(pa.array(at, pa.int32()))
            yield pa.record_batch([*kept.columns[1:], _lists(sets)], names=["component", "blocks", "block", "node", "shingles"])

    members = members.select("content", "_id", "n", "component", "blocks", "block", "node")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("content"), F.monotonically_increasing_id().alias("_row"))
    rows = join_hot(rows, members, "content", "_row").where(F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "component", "blocks", "block", "node")
    return rows.mapInArrow(run, "component long, blocks int, block int, node long, shingles array<long>")


def _links(values: np.ndarray, offsets: np.ndarray, least: float, split: int | None = None) -> Iterator[tuple[int, int]]:
    """Edges between positions of non-empty sets that connect exactly what pairs of at least that similarity connect (between positions below and from split if given).

    Each set looks once at the sets that nothing has reached yet, so there are fewer edges than sets.
    """
    names, codes = np.unique(values, return_inverse=True)
    sizes = np.diff(offsets)
    mark = np.zeros(len(names), dtype=bool)
    rest, held = np.arange(len(sizes)), codes

    def keep(which: np.ndarray) -> None:
        nonlocal rest, held
        held, rest = held[np.repeat(which, sizes[rest])], rest[which]

    while len(rest):
        todo = [int(rest[0])]
        keep(np.arange(len(rest)) > 0)
        while todo and len(rest):
            at = todo.pop()
            own = codes[offsets[at] : offsets[at + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[held], np.r_[0, np.cumsum(sizes[rest])[:-1]], dtype=np.int64)
            mark[own] = False
            near = both / (sizes[rest] + sizes[at] - both) >= least
            if split is not None:
                near &= (rest >= split) != (at >= split)
            found = rest[near].tolist()
            if found:
                keep(~near)
                todo.extend(found)
                for other in found:
                    yield at, other


def _linker(least: float):
    """For rows (component, i, j, block, node, shingles) sorted by the first five: the edges within each (component, i, j). Rows that repeat are dropped as they come."""

    def edges(rows: pa.Table, keys: np.ndarray) -> pa.RecordBatch:
        nodes, lists = rows["node"].to_numpy(), rows["shingles"].combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        cuts = np.flatnonzero((keys[1:, :3] != keys[:-1, :3]).any(axis=1)) + 1
        pairs: list[tuple[int, int]] = []
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
            split = None if keys[s, 1] == keys[s, 2] else int((keys[s:e, 3] == keys[s, 1]).sum())
            for a, b in _links(values[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], least, split):
                pairs.append((s + a, s + b))
        u, v = stars(nodes, *np.array(pairs, dtype=np.int64).reshape(-1, 2).T)
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key: np.ndarray | None = None  # of what is held: one group, which may go on in the next batch
        last: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("component", "i", "j", "block", "node")], axis=1)
            fresh = np.r_[last is None or (keys[0] != last).any(), (keys[1:] != keys[:-1]).any(axis=1)]
            last = keys[-1]
            if not fresh.all():
                table, keys = table.filter(pa.array(fresh)), keys[fresh]
            keys = keys[:, :4]
            if not len(keys):
                continue
            others = np.flatnonzero((keys[:, :3] != keys[-1, :3]).any(axis=1))
            cut = int(others[-1]) + 1 if len(others) else 0
            if held and (cut or (keys[0, :3] != key[0, :3]).any()):
                yield edges(pa.concat_tables([*held, table.slice(0, cut)]), np.concatenate([key, keys[:cut]]))
                held, key = [], None
            elif cut:
                yield edges(table.slice(0, cut), keys[:cut])
            held.append(table.slice(cut))
            key = keys[cut:] if key is None else np.concatenate([key, keys[cut:]])
        if held:
            yield edges(pa.concat_tables(held), key)

    return run


def _compare(dealt: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) of rows (component, i, j, block, node, shingles): within each (component, i, j), between its blocks i and j where these differ."""
    tasks = dealt.select("component", "i", "j", "block", "node", "shingles").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "block", "node")
    return tasks.mapInArrow(_linker(least), "u long, v long")


def _up_to(n) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _part(parts, salt: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), parts.cast("long")).cast("int")


def _blocks(count: Column, cells: Column, block: int) -> Column:
    """So many blocks that one holds about block sets and CELLS shingles at most."""
    return F.greatest(F.ceil(count / block), F.ceil(cells / CELLS)).cast("int")


def links(docs: DataFrame, values: DataFrame, edges: DataFrame, least: float = 0.8, shingle: int = 5, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between nodes that connect what pairs of at least that similarity within a candidate group connect.

    values is that of distinct_sets() for docs(doc_id, text); edges(u, v) are candidates, which group nodes directly or through others.
    Sets of a group are compared by their shingles; texts without candidates are not read again.
    A group over the block size is compared block by block first. Then one set of each part that has come together goes in pairs of blocks; where parts remain, all sets
    outside of the largest part are compared with the whole group, block by block. So no pair that could connect is left out, and a group of
    near copies that come together costs what its size does. Each task yields fewer edges than it has members.
    """
    groups = stash(components(edges).join(values.select("node", "content", "_id", "n", "size"), "node"), "groups")
    large = groups.groupBy("component").agg(_blocks(F.count("*"), F.sum("size"), block).alias("blocks")).where("blocks > 1")
    members = groups.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = stash(members.withColumn("block", _part(F.col("blocks"), 1)), "members")  # for its size: few members need no exchange of texts
    found = stash(_compare(_sets(docs, members, shingle).select("*", F.col("block").alias("i"), F.col("block").alias("j")), least), "alone")
    several = members.where("blocks > 1")
    if several.isEmpty():
        return found

    def parts() -> tuple[DataFrame, DataFrame]:
        """Members of groups still apart with the name of their part; and (component, name, node, n): the parts, a set of each, and its size."""
        names = components(found).withColumnsRenamed({"component": "name"})
        named = stash(several.join(names, "node", "left").withColumn("name", F.coalesce("name", "node")), "named")
        each = stash(named.groupBy("component", "name").agg(F.min("node").alias("node"), F.count("*").alias("n"), F.sum("size").alias("cells"), F.min_by("size", "node").alias("size")), "parts")
        most = F.struct("n", "name")
        others = [(F.sum("n") - F.max("n")).alias("others"), (F.sum("cells") - F.max_by("cells", most)).alias("other_cells"), F.sum("size").alias("one_cells")]
        apart = each.groupBy("component").agg(F.count("*").alias("parts"), F.max_by("name", most).alias("largest"), *others).where("parts > 1")
        return named.join(apart, "component"), each.join(apart, "component")

    _, each = parts()
    one = several.select("node", "content", "_id", "n").join(each.select("component", "node", _blocks(F.col("parts"), F.col("one_cells"), block).alias("blocks")), "node")
    one = stash(one.withColumn("block", _part(F.col("blocks"), 2)), "members")
    dealt = _sets(docs, one, shingle).withColumn("other", F.explode(_up_to(F.col("blocks"))))
    found = stash(found.union(_compare(dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}), least)), "ones")
    named, _ = parts()
    others = _blocks(F.col("others"), F.col("other_cells"), block)
    rest = stash(named.select("node", "content", "_id", "n", "component", "blocks", "block", others.alias("rounds"), (F.col("name") != F.col("largest")).alias("aside")), "rest")
    sets = _sets(docs, rest, shingle).join(rest.select("node", "rounds", "aside"), "node")
    whole = sets.withColumn("i", F.explode(F.transform(_up_to(F.col("rounds")), lambda r: -1 - r))).withColumn("j", F.col("block"))
    aside = sets.where("aside").withColumn("i", -1 - _part(F.col("rounds"), 3)).withColumn("j", F.explode(_up_to(F.col("blocks")))).withColumn("block", F.col("i"))
    return found.union(_compare(whole.unionByName(aside), least))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, miss: float = MISS) -> DataFrame:
    """One row per input row: doc_id, component_id.

    Documents are linked if the Jaccard similarity of their shingle sets is at least least; component_id is the smallest non-null
    doc_id reachable, itself included. Equal sets are merged before any comparison, and so are null and wordless texts, which have
    none. Candidates share a bucket of covering SimHash (simhash.covering_plan) and every link is verified on the whole sets. What is missed are pairs
    without a common bucket: by calculation the share miss at the least similarity, at any number of documents, and fewer above. Repeated rows
    have one component. Texts of any length are compared whole; blocks of compared sets are bounded by their shingles. Other columns are ignored. An empty table gives none.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    plan = simhash.covering_plan(docs.count(), least, miss)
    rows = stash(sketches(docs, plan[0] + COMPARED, shingle), "sketches")
    values = stash(distinct_sets(rows), "values")
    edges = links(docs, values, candidates(values.where("fingerprint is not null"), plan, least), least, shingle)
    label = stash(components(edges), "components")
    linked = least_of(values.select("node", "first_id").join(label, "node"), "component", "first_id", "node", "component_id").select("node", F.col("component_id").alias("_least"))
    found = stash(values.join(linked, "node", "left").select("node", F.coalesce("_least", "first_id").alias("component_id"), "n"), "found")
    return join_hot(rows.select("doc_id", "node"), found, "node", "doc_id").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, miss: float = MISS) -> DataFrame:
    """The rows of docs with one document of each near_copies() component: that of the smallest doc_id.

    Null, empty and wordless texts are copies of each other. Rows of a doc_id that stays anywhere stay (drop exact copies first), and so do rows
    without an id. All columns are kept, whatever their names. An empty table gives none. What goes is joined by id, and is usually few
    enough for Spark to broadcast by its size.
    """
    found = stash(near_copies(docs, id_col, text_col, shingle, least, miss), "components")
    stays = found.where("doc_id = component_id").select("doc_id")
    goes = found.where("doc_id <> component_id").select("doc_id").distinct().join(stays, "doc_id", "left_anti")
    goes = stash(goes.select(F.col("doc_id").alias("_goes")), "goes")
    discard(found)
    return docs.join(goes, docs[id_col].cast("long") == goes["_goes"], "left_anti")
