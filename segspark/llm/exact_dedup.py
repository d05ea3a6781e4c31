"""Exact dedup through a cuckoo-filter index over content digests."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, stash

SLOTS = 4
MAX_KICKS = 250
# Fixed value: the odd multiplier (of MurmurHash2) that turns a tag into the distance of its two buckets.
TAG_MULTIPLIER = 0x5BD1E995
#: A map task hands its groups on when its index holds so many live keys, so its memory stays bounded.
FLUSH_KEYS = 200_000


class CuckooIndex:
    """Cuckoo filter of 16-bit tags whose slots also point at the stored keys.

    A lookup reads the tags of two buckets; a hit is verified against the full key that the slot
    stores. A key that finds no place after MAX_KICKS moves doubles the table, which is refilled from
    the stored keys. Keys must be uniformly distributed bytes of 16 or more (digests).
    """

    def __init__(self, buckets: int = 256):
        self._clear(buckets)
        self.keys: list[bytes | None] = []
        self._free: list[int] = []

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = array("H", bytes(2 * SLOTS * buckets))
        self.refs = array("q", bytes(8 * SLOTS * buckets))

    def __len__(self) -> int:
        return len(self.keys) - len(self._free)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        head, tag = struct.unpack_from("<QH", key)
        tag = tag or 1
        first = head & self.mask
        return first, first ^ (tag * TAG_MULTIPLIER & self.mask), tag

    def find(self, key: bytes) -> int:
        """The key's reference, or -1."""
        first, second, tag = self._place(key)
        tags, refs, keys = self.tags, self.refs, self.keys
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if tags[slot] == tag and keys[refs[slot]] == key:
                    return refs[slot]
        return -1

    def add(self, key: bytes) -> tuple[int, bool]:
        """The key's reference, and whether it is new."""
        ref = self.find(key)
        if ref >= 0:
            return ref, False
        if self._free:
            ref = self._free.pop()
            self.keys[ref] = key
        else:
            ref = len(self.keys)
            self.keys.append(key)
        self._insert(ref)
        return ref, True

    def remove(self, key: bytes) -> int:
        """Delete a live key; its former reference, or -1 if it wasn't there."""
        first, second, tag = self._place(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                ref = self.refs[slot]
                if self.tags[slot] == tag and self.keys[ref] == key:
                    self.tags[slot] = 0
                    self.keys[ref] = None
                    self._free.append(ref)
                    return ref
        return -1

    def _insert(self, ref: int) -> None:
        """Place a stored key; when it or another finds no place the table doubles, once or more, and is refilled from the stored keys."""
        if not self._settle(ref):
            size, settled = self.mask + 1, False
            while not settled:
                size *= 2
                self._clear(size)
                settled = all(self._settle(r) for r, key in enumerate(self.keys) if key is not None)

    def _settle(self, ref: int) -> bool:
        """Place a stored key, moving others; False if one (this or another) is left without a place."""
        first, second, tag = self._place(self.keys[ref])
        bucket = first
        for kick in range(MAX_KICKS):
            for b in (bucket, second) if kick == 0 else (bucket,):
                for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.tags[slot]:
                        self.tags[slot], self.refs[slot] = tag, ref
                        return True
            slot = bucket * SLOTS + kick % SLOTS
            tag, self.tags[slot] = self.tags[slot], tag
            ref, self.refs[slot] = self.refs[slot], ref
            bucket ^= tag * TAG_MULTIPLIER & self.mask
        return False


_GROUP = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("keep_id", T.LongType()), T.StructField("n", T.LongType()),
])
_GROUP_ARROW = pa.schema([("key", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch], in_order: bool) -> Iterator[pa.RecordBatch]:
    """Merge rows of one key. The index holds FLUSH_KEYS keys; it is handed on when full.

    In order of the keys that is final for all but the last key, which goes on; otherwise a key may come out again later.
    """
    index, keep, total = CuckooIndex(), [], []

    def out(upto: int):
        for i in range(0, upto, 10_000):
            e = min(i + 10_000, upto)
            yield pa.record_batch([index.keys[i:e], keep[i:e], total[i:e]], schema=_GROUP_ARROW)

    for batch in batches:
        for key, doc, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ref, new = index.add(key)
            if new:
                keep.append(doc)
                total.append(n)
            else:
                total[ref] += n
                if keep[ref] is None or doc is not None and doc > keep[ref]:
                    keep[ref] = doc
        if len(index) >= FLUSH_KEYS:
            done = len(index) - in_order
            yield from out(done)
            rest = list(zip(index.keys[done:], keep[done:], total[done:], strict=True))
            index, keep, total = CuckooIndex(), [r[1] for r in rest], [r[2] for r in rest]
            for key, *_ in rest:
                index.add(key)
    yield from out(len(index))


def content_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key) per row: key is the text's SHA-256 and its length in bytes; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.lpad(F.hex(F.octet_length(text)), 16, "0")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.concat(F.sha2(text, 256), size)).alias("key"))


def groups(keys: DataFrame) -> DataFrame:
    """(key, keep_id, n) per distinct content of keys(doc_id, key).

    Each task first merges its own rows in a cuckoo index, so a content that holds a third of all rows
    reaches the shuffle as one row a task; the merged rows then meet, sorted by key, in the index of their key's partition. Neither index
    outgrows FLUSH_KEYS keys and a batch.
    """
    rows = keys.select("key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    local = rows.mapInArrow(lambda it: _merge(it, False), _GROUP)
    return local.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _merge(it, True), _GROUP)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (null ids rank lowest). Of rows that repeat both
    id and text exactly one is kept. Null texts equal empty ones. Texts of any length are compared whole. Other columns are ignored. An empty table gives none. The rows of a
    frequent text are joined with their group in parts.
    """
    keys = stash(content_keys(docs, id_col, text_col), "keys")
    found = stash(groups(keys), "groups")
    rows = keys.groupBy("doc_id", "key").agg(F.count("*").cast("int").alias("times"))
    return join_hot(rows, found, "key", "doc_id").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1), "times")).alias("copy"),
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def _orderable(kind: T.DataType) -> bool:
    """Whether values of a type can be sorted: not if there is a map or a variant anywhere in it."""
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return not isinstance(kind, (T.MapType, T.VariantType)) and all(map(_orderable, inner))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates() keeps, with all their columns, whatever their names.

    Null texts equal empty ones, and null ids rank lowest. Of rows that repeat id and text the first by the other columns stays (any one where
    only columns that can't be sorted differ). An empty table gives none. Content and id make up one key, by which the rows are joined with
    what stays and repeated rows told apart: the texts are shuffled once.
    """

    def place(key, doc):
        return F.concat(key, F.coalesce(doc.cast("string"), F.lit("-")).cast("binary")).alias("at")

    stay = stash(groups(content_keys(docs, id_col, text_col)).select(place(F.col("key"), F.col("keep_id"))), "stay")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.concat(F.sha2(text, 256), F.lpad(F.hex(F.octet_length(text)), 16, "0")))
    kept = docs.select(F.struct("*").alias("row"), place(key, F.col(id_col).cast("long"))).join(stay, "at")
    others = [F.col("row")[f.name] for f in docs.schema.fields if f.name != text_col and _orderable(f.dataType)]
    first = F.row_number().over(Window.partitionBy("at").orderBy(*(others or [F.lit(0)])))
    return kept.withColumn("first", first).where("first = 1").select("row.*")


# -- a kept index: build once, then apply insertions and deletions ------------------------------------

#: Live keys that a bucket of a kept index holds on average at most once fit_index() has seen it.
BUCKET_KEYS = 100_000
_INDEX = "bucket int, buckets int, tags binary, refs binary, keys array<binary>"


def _dump(bucket: int, index: CuckooIndex) -> pa.Table:
    return pa.table(
        {"bucket": pa.array([bucket], pa.int32()), "buckets": pa.array([index.mask + 1], pa.int32()), "tags": [index.tags.tobytes()], "refs": [index.refs.tobytes()], "keys": pa.array([index.keys], pa.list_(pa.binary()))}
    )


def _load(row: dict) -> CuckooIndex:
    index = CuckooIndex(row["buckets"])
    index.tags, index.refs = array("H", row["tags"]), array("q", row["refs"])
    index.keys = list(row["keys"])
    index._free = [i for i, k in enumerate(index.keys) if k is None]
    return index


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")


def build_index(keys: DataFrame, buckets: int) -> DataFrame:
    """An index table of one cuckoo filter per bucket over the distinct keys of keys(key).

    Choose buckets so that keys / buckets stays below BUCKET_KEYS; fit_index() sees to it as the index grows. Null keys are left out.
    """
    def build(table: pa.Table) -> pa.Table:
        index = CuckooIndex()
        for key in table["key"].to_pylist():
            index.add(key)
        return _dump(table["bucket"][0].as_py(), index)

    return keys.select("key").where("key IS NOT NULL").distinct().select(_bucket(buckets), "key").groupBy("bucket").applyInArrow(build, _INDEX)


def live_keys(index: DataFrame) -> DataFrame:
    """(key) of all keys that the index holds."""
    return index.select(F.explode("keys").alias("key")).where("key IS NOT NULL")


def fit_index(index: DataFrame, buckets: int, most: int | None = None) -> tuple[DataFrame, int]:
    """The index and its number of buckets, refilled from its stored keys into twice as many, or four times, and so on, if buckets hold over most (BUCKET_KEYS) live keys on average.

    Keys are digests, so buckets fill evenly. Call it after update_index(), so that no task outgrows its memory however long the index is kept; an index with few enough keys comes back as it is. An
    empty one stays empty.
    """
    held = index.agg(F.sum(F.size(F.filter("keys", lambda k: k.isNotNull())))).first()[0] or 0
    wanted = buckets
    while held > wanted * (most or BUCKET_KEYS):
        wanted *= 2
    return (index, buckets) if wanted == buckets else (build_index(live_keys(index), wanted), wanted)


def update_index(index: DataFrame, changes: DataFrame, buckets: int) -> DataFrame:
    """The index after changes(key, live): live rows are inserted, others (also null ones) deleted. A key may occur once in changes; null keys change nothing."""
    def update(old: pa.Table, new: pa.Table) -> pa.Table:
        filt = _load(old.to_pylist()[0]) if old.num_rows else CuckooIndex()
        for key, live in zip(new["key"].to_pylist(), new["live"].to_pylist(), strict=True):
            filt.add(key) if live else filt.remove(key)
        return _dump((old if old.num_rows else new)["bucket"][0].as_py(), filt)

    changes = changes.where("key IS NOT NULL")
    return index.groupBy("bucket").cogroup(changes.select(_bucket(buckets), "key", "live").groupBy("bucket")).applyInArrow(update, _INDEX)


def probe_index(index: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """(key, live) per distinct key of keys(key): whether the index holds it, verified against its stored keys. Null keys are not asked for."""
    def probe(old: pa.Table, new: pa.Table) -> pa.Table:
        filt = _load(old.to_pylist()[0]) if old.num_rows else CuckooIndex()
        asked = new["key"].to_pylist()
        return pa.table({"key": pa.array(asked, pa.binary()), "live": pa.array([filt.find(k) >= 0 for k in asked], pa.bool_())})

    asked = keys.select("key").where("key IS NOT NULL").distinct().select(_bucket(buckets), "key")
    return index.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(probe, "key binary, live boolean")
