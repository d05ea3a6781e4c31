"""Secret scan with multipart credential linking (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

# The base kinds, in the order in which they are listed, and their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# Weak kinds: reported only where a complementary part is near.
WEAK_ID = r"""(?i:user_?name|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK_SECRET = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9.@:_-]+"

KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
#: Parts whose starts are at most so many characters apart stand in one scope.
SCOPE = 256
_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


#: Matches of a text are placed in chunks of so many, so that the work for a text is near linear in its matches.
CHUNK = 64


def _steps(text: Column, pattern: str, keep, maybe: Column) -> Column:
    """(gap, size, keep) of the leftmost non-overlapping matches: the characters before each, its own, and what keep(match) says. None where maybe is false."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), keep(hit).alias("keep")))
    return F.when(maybe, F.filter(steps, lambda x: x["size"].isNotNull())).otherwise(F.array().cast("array<struct<gap:int,size:int,keep:boolean>>"))


def _chunks(steps: str) -> Column:
    return F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(CHUNK)), lambda i: F.slice(steps, i, F.lit(CHUNK))))


def _spans(chunks: str, kind: str) -> Column:
    """Spans of the steps that are kept. Gaps and matches alternate, so their lengths add up to positions: over chunks first, then within each."""
    rank, zero, none = KINDS.index(kind), F.lit(0).cast("bigint"), F.array().cast(f"array<{_SPAN}>")
    totals = F.transform(chunks, lambda chunk: F.aggregate(chunk, zero, lambda acc, x: acc + x["gap"] + x["size"]))

    def ahead(acc: Column, total: Column) -> Column:
        return F.struct((acc["at"] + total).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen"))

    bases = F.aggregate(totals, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("seen")), ahead, lambda acc: acc["seen"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).alias("end"), F.lit(kind).alias("kind"))
        return F.struct((start + x["size"]).alias("at"), F.when(x["keep"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    within = F.zip_with(chunks, bases, lambda chunk, base: F.aggregate(chunk, F.struct(base.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"]))
    return F.coalesce(F.flatten(within), none)


def _mixed(hit: Column) -> Column:
    return hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")


def _has(text: str, *needles: str) -> Column:
    return reduce(Column.__or__, [F.contains(F.col(text), F.lit(n)) for n in needles])


def _search(rows: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """rows with a column of spans for each kind in wanted(kind -> its steps). Each step is a projection of its own, so that none is worked out twice."""
    others = rows.columns
    stepped = rows.select(*others, *[steps.alias(kind) for kind, steps in wanted.items()])
    chunked = stepped.select(*others, *[_chunks(kind).alias(kind) for kind in wanted])
    return chunked.select(*others, *[_spans(kind, kind).alias(kind) for kind in wanted])


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content, base, weak) per row: the spans of the base kinds, and the weak candidates; content is a hash of the text.

    Patterns that hold a fixed string are only tried on texts that contain it. Weak candidates are reported only with an identifier
    near, so texts without one need no search for the others.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.lower("text"))
    may = {"assign": _has("low", "passw", "secret", "token", "api"), "id": _has("low", "name", "login", "client", "account", "access"), "access": _has("text", "AKIA"), "hex": F.col("text").rlike("[0-9a-f]{32}")}
    rows = rows.select("doc_id", "text", *[c.alias(f"may_{k}") for k, c in may.items()])
    text, always = F.col("text"), lambda hit: F.lit(True)
    rows = _search(rows, {
        "assign": _steps(text, ASSIGN, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8, F.col("may_assign")),
        "access": _steps(text, ACCESS, lambda hit: F.length(hit) >= 16, F.col("may_access")),
        "hex": _steps(text, "(?<![0-9a-f])[0-9a-f]{32,}", always, F.col("may_hex")),
        "weak_id": _steps(text, WEAK_ID, always, F.col("may_id")),
    }).select("doc_id", "text", "assign", "access", "hex", "weak_id")
    named = F.size("access") + F.size("weak_id") > 0
    rows = _search(rows, {"weak_secret": _steps(text, WEAK_SECRET, _mixed, named), "endpoint": _steps(text, ENDPOINT, always, named)})
    return rows.select("doc_id", F.xxhash64("text").alias("content"), F.concat("assign", "access", "hex").alias("base"), F.concat("weak_id", "weak_secret", "endpoint").alias("weak"))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, content, spans) of the weak candidates of parts() whose complementary parts co-occur in their scope.

    A weak identifier needs a secret, a weak secret an identifier, an endpoint both, each starting at most scope characters away and not
    overlapping it: nothing complements itself. What overlaps a base finding is no candidate, as it is found already, and what is read as part of a weak
    identifier is not read as a weak secret as well. An interval join: starts are bucketed by the scope's width, and a candidate meets the parts of its own
    and the neighbouring buckets; spans of a kind don't overlap, so a bucket holds few, whatever the text's length.
    """
    rows = found.where(F.size("weak") > 0).select("doc_id", "content", F.explode(F.concat("base", "weak")).alias("span")).distinct()
    rows = rows.select("doc_id", "content", "span", "span.start", "span.end", "span.rank", "span.kind", F.floor(F.col("span.start") / scope).alias("bucket"))
    text = Window.partitionBy("doc_id", "content").orderBy("start", "rank")
    before, after = text.rowsBetween(Window.unboundedPreceding, -1), text.rowsBetween(1, Window.unboundedFollowing)

    def overlaps(ranks: int) -> Column:
        of = lambda c: F.when(F.col("rank") < ranks, F.col(c))
        sides = F.max(of("end")).over(before) > F.col("start"), F.min(of("start")).over(after) < F.col("end")
        return F.coalesce(sides[0], F.lit(False)) | F.coalesce(sides[1], F.lit(False))

    rows = rows.withColumn("taken", F.when(F.col("kind") == "weak_secret", overlaps(4)).otherwise((F.col("rank") > 2) & overlaps(3))).where("not taken").drop("taken")

    def having(candidates: DataFrame, *kinds: str) -> DataFrame:
        near = rows.where(F.col("kind").isin(*kinds)).select(
            F.col("doc_id").alias("_id"), F.col("content").alias("_content"), F.col("start").alias("_start"), F.col("end").alias("_end"),
            F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])).alias("_bucket"),
        )
        same = candidates["doc_id"].eqNullSafe(near["_id"]) & (candidates["content"] == near["_content"]) & (candidates["bucket"] == near["_bucket"])
        apart = (near["_end"] <= candidates["start"]) | (near["_start"] >= candidates["end"])
        return candidates.join(near, same & apart & (F.abs(near["_start"] - candidates["start"]) <= scope), "left_semi")

    ids, secrets = ("access", "weak_id"), ("assign", "hex", "weak_secret")
    linked = [having(rows.where("kind = 'weak_id'"), *secrets), having(rows.where("kind = 'weak_secret'"), *ids), having(having(rows.where("kind = 'endpoint'"), *ids), *secrets)]
    return reduce(DataFrame.union, linked).groupBy("doc_id", "content").agg(F.collect_set("span").alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Positions count code points, ends are exclusive. Null texts are empty; texts without findings have zero counts, the digest of the empty string
    and empty spans. Texts of any length are searched whole. Rows that repeat id and text report alike. Other columns are ignored. An empty table gives none.
    """
    found = stash(parts(docs, id_col, text_col), "parts")
    near = stash(link(found, scope), "linked").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "spans")
    rows = found.join(near, found["doc_id"].eqNullSafe(near["_id"]) & (found["content"] == near["_content"]), "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.when(F.col("spans").isNull(), F.col("base")).otherwise(F.concat("base", "spans"))
    return rows.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"))
