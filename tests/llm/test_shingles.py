"""Near copies against brute force over sets of shingles."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from segspark.llm import common, shingles, simhash

from .test_operators import _reach, _text

SF = "/root/testdata/sf0.01"


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _brute_force(rows, least=0.8):
    sets = {i: _shingles(t) for i, t in rows}
    same = lambda a, b: len(a & b) / len(a | b) >= least if a or b else True
    return _reach(sets, [(a, b) for a, b in combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= least * max(len(sets[a]), len(sets[b])) and same(sets[a], sets[b])])


def _edited(rng, base, words):
    at = rng.sample(range(len(base)), words)
    return " ".join("edit%d" % rng.getrandbits(40) if i in at else w for i, w in enumerate(base))


@pytest.fixture(scope="module")
def rows():
    """Pairs of every similarity around 0.8, which have no other link; a chain; a group of many; copies; short and empty texts."""
    rng, out = random.Random(3), []
    for _ in range(200):
        base = _text(rng, 300).split()
        out += [" ".join(base), _edited(rng, base, rng.randint(3, 9))]
    chain = _text(rng, 200).split()
    for k in range(6):
        chain[20 * k] = "link%d" % k
        out.append(" ".join(chain))
    hub = _text(rng, 200).split()
    out += [_edited(rng, hub, rng.randint(0, 3)) for _ in range(60)]
    out += ["A few Words", "a few\nwords", "a few words more", None, "", " \t", "one two three four five", "one two three four five six"]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [7, 512])
def test_verified_links_equal_brute_force(spark, rows, block):
    """All rows as one candidate group: the links among them are exactly those of their sets."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("text", F.col("text").cast("binary"))
    values = shingles.distinct_sets(shingles.sketches(docs, 1).where("fingerprint is not null"))
    nodes = sorted(values.collect())
    edges = spark.createDataFrame([(a.node, b.node) for a, b in zip(nodes, nodes[1:])], "u long, v long")
    first = {r.node: r.first_id for r in nodes}
    found = [(first[r.u], first[r.v]) for r in shingles.links(docs, values, edges, block=block).collect()]
    want = _brute_force([r for r in rows if r[0] in set(first.values())])
    assert 20 < sum(want.get(2 * i) == want.get(2 * i + 1, -1) for i in range(200)) < 180
    assert _reach(want, found) == want


def test_near_copies_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _brute_force(rows)
    assert {r.doc_id: r.component_id for r in shingles.near_copies(docs, miss=1e-4).collect()} == want
    assert sorted(r.doc_id for r in shingles.drop_near_copies(docs, miss=1e-4).collect()) == sorted({*want.values()})
    assert shingles.near_copies(docs.where("false")).count() == 0 and shingles.drop_near_copies(docs.where("false")).count() == 0


@pytest.mark.parametrize("count", [200, 50_000, 10**7, 10**10])
def test_candidates_meet_at_the_least_similarity_at_every_count(count):
    """Pairs of sets at 0.8 (sizes equal or not), by their real fingerprints, without Spark."""
    words, bits, radius = simhash.covering_plan(count, 0.8, shingles.MISS)
    masks = np.array(simhash.covering_masks(radius, bits), dtype=np.uint64)
    rng, met, passed, n = np.random.default_rng(5), 0, 0, 400
    for k in range(n):
        common = rng.integers(0, 2**63, 160, dtype=np.uint64)
        extra = rng.integers(0, 2**63, 40, dtype=np.uint64)
        cut = (0, 10, 20)[k % 3]
        a, b = (shingles.set_fingerprint(np.concatenate([common, x]), words + shingles.COMPARED) for x in (extra[:cut], extra[cut:]))
        met += (((a ^ b)[:words, None] & masks) == 0).any()
        passed += np.bitwise_count((a ^ b)[words:]).sum() <= 36
    assert met >= 0.975 * n and passed >= 0.995 * n


def test_repeated_rows_ids_and_clashing_names(spark):
    one, other = "a b c d e f g", "A b c d  e f g"
    rows = [(1, one), (1, one), (1, "something else entirely"), (2, other), (None, one), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("node", "component", "component_id", "_goes", "_id", "n", "fingerprint", "block"):
        docs = docs.withColumn(name, F.lit(name))
    got = shingles.near_copies(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1), (1, 1), (1, 1), (2, 1), (None, 1), (None, 3), (3, 3)], key=repr)
    kept = shingles.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.n, r._goes) for r in kept.collect()) == sorted([(i, "n", "_goes") for i in (0, 0, 1, 1, 1, 3)])


@pytest.mark.parametrize(("first", "other"), [(None, None), (7, 7), (None, 7)])
def test_rows_that_share_an_id_are_shingled_once(spark, first, other):
    """1,200 near copies without an id, or all of one id: every candidate text is read again once, and all come together."""
    rng = random.Random(4)
    base = _text(rng, 120).split()
    rows = [(first if i % 2 else other, _edited(rng, base, 1)) for i in range(1200)] + [(9, "some other text of its own")]
    docs = common.stash(spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("text", F.col("text").cast("binary")))
    values = common.stash(shingles.distinct_sets(shingles.sketches(docs, 1)))
    members = values.where("size > 10").selectExpr("content", "_id", "n", "node", "0L component", "1 blocks", "0 block")
    sets = shingles._sets(docs, members, 5)
    joined = sets._jdf.queryExecution().analyzed().toString()
    assert "content" in joined and sets.count() == 1200 == members.count()
    assert shingles._sets(docs, members, 5).select("node").distinct().count() == 1200
    found = shingles.near_copies(docs)
    smallest = min((i for i in (first, other) if i is not None), default=None)
    assert sorted(((r.doc_id, r.component_id) for r in found.collect()), key=repr) == sorted([(r[0], smallest) for r in rows[:1200]] + [(9, 9)], key=repr)


def test_texts_read_again_are_as_many_as_candidates(spark):
    """Counted where texts are shingled: rows that share an id do not multiply."""
    rows = [(None, f"text number {i} without an id") for i in range(1200)] + [(1, f"text number {i} of one id") for i in range(1200)]
    docs = common.stash(spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.col("text").cast("binary")))
    values = common.stash(shingles.distinct_sets(shingles.sketches(docs, 1)))
    members = values.selectExpr("content", "_id", "n", "node", "0L component", "1 blocks", "0 block")
    read = docs.select("doc_id", F.xxhash64("text").alias("content"), F.monotonically_increasing_id().alias("_row"))
    assert common.join_hot(read, members, "content", "_row").count() == 2400


@pytest.mark.parametrize("block", [7, 512])
def test_blocks_bounded_by_shingles_find_the_same(spark, rows, block, monkeypatch):
    monkeypatch.setattr(shingles, "CELLS", 900)
    test_verified_links_equal_brute_force.__wrapped__(spark, rows, block) if hasattr(test_verified_links_equal_brute_force, "__wrapped__") else test_verified_links_equal_brute_force(spark, rows, block)


def test_rows_without_an_id_stay(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (None, "A b c d e f"), (None, "other"), (7, "a b c d  e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in shingles.drop_near_copies(docs).collect()) == [0, 0, 5]


def test_stage_on_documents_equals_brute_force(spark):
    docs = common.stash(dict(corpus_pipeline.STAGES)["exact_dedup"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF))
    want = _brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted({*want.values()})
