"""Cross-site boilerplate lines by distinct-site spread (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stash

#: Lines on at least so many sites are boilerplate.
MIN_SITES = 10
#: Sketches have 2**LG_K registers; their relative standard error is 1.04 / sqrt(2**LG_K).
LG_K = 12
#: Estimates within so many standard errors of the threshold (and one site at least) are replaced by exact counts.
ERRORS = 6


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """Lines are equal up to white space at either end; blank lines have no key."""
    bare = F.regexp_replace(line, "^[ \\t-\\r]+|[ \\t-\\r]+$", "")
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(keys: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, n) of keys(doc, site, lines array<bigint>) that occur on at least min_sites sites, in n documents.

    One HyperLogLog sketch of sites per line hash is built in each task and merged by the shuffle, so a line that every
    document holds costs one sketch a task. Estimates clearly off the threshold decide; the lines near it get an exact count
    of their distinct (line, site) pairs. The documents of a frequent line are split by doc where they are joined with it.
    """
    rows = keys.select("doc", "site", F.explode("lines").alias("line"))
    spread = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count("*").alias("n"))
    margin = max(1, round(ERRORS * 1.04 / 2 ** (LG_K / 2) * min_sites))
    likely = stash(spread.where(F.col("sites") >= min_sites - margin), "spread")
    near = likely.where(F.col("sites") <= min_sites + margin).select("line", "n")
    pairs = join_hot(rows, near, "line", "doc").select("line", "n", "site").distinct()
    exact = pairs.groupBy("line", "n").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("line", "n")
    return likely.where(F.col("sites") > min_sites + margin).select("line", "n").union(exact)


def _is_in(gone: Column, steps: Column, key: Column) -> Column:
    """Whether key is in the sorted array gone, by halves: steps are the powers of two up to its size, the largest first."""
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(gone, at + step - 1) <= key, at + step).otherwise(at))
    return F.get(gone, place - 1).eqNullSafe(key)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, clean_text.

    A line goes, wherever it stands, if its text (without white space at its ends) occurs on at least min_sites distinct values of site_col. Blank
    lines stay. A null site is a site of its own; a null text is empty and has one blank line. Rows that repeat id and text are cleaned
    alike. A text of very many lines costs in proportion to them, times the logarithm of those that go. Other columns are ignored. An empty table gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(site_col).cast("string").alias("site"), text.alias("text"))
    content = F.xxhash64("text").alias("content")
    keyed = rows.select("doc_id", content, F.xxhash64("doc_id", "text").alias("doc"), F.coalesce("site", F.lit("\0")).alias("site"), F.array_compact(F.array_distinct(F.transform(_lines(F.col("text")), _key))).alias("lines"))
    keyed = stash(keyed, "lines")
    found = stash(boilerplate(keyed, min_sites), "boilerplate")
    hits = join_hot(keyed.select("doc", "doc_id", "content", F.explode("lines").alias("line")), found, "line", "doc")
    removed = hits.groupBy("doc_id", "content").agg(F.array_sort(F.collect_set("line")).alias("gone"))
    powers = F.lit([1 << b for b in range(30, -1, -1)])
    removed = stash(removed.select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "gone", F.filter(powers, lambda p: p <= F.size("gone")).alias("steps")), "removed")
    both = rows.withColumn("_c", F.xxhash64("text")).join(removed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_c") == F.col("_content")), "left")
    pairs = F.transform(_lines(F.col("text")), lambda line: F.struct(line.alias("line"), _key(line).alias("key")))
    stays = F.filter(pairs, lambda p: p["key"].isNull() | ~_is_in(F.col("gone"), F.col("steps"), p["key"]))
    kept = F.when(F.col("gone").isNull(), _lines(F.col("text"))).otherwise(F.transform(stays, lambda p: p["line"]))
    cleaned = both.select("doc_id", F.size(_lines(F.col("text"))).alias("n_lines"), kept.alias("kept"))
    return cleaned.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("clean_text"))
