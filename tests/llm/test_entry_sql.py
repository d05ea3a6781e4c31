"""Registered queries of the subpackage against their SQL, and the pipeline against its own stages in plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from segspark.llm import bpe, common, queries

from .plain_language import PlainModel

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(duck.sql(f"SELECT {columns} FROM want").fetchall(), key=repr)


def _words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _near_kept(texts):
    """Of texts {id: text}: the smallest id of each group of five-word Jaccard similarity 0.8 or more."""
    sets = {}
    for i, text in texts.items():
        words = _words(text)
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    near = defaultdict(list)
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (not x | y or len(x & y) / len(x | y) >= 0.8):
            near[a].append(b)
            near[b].append(a)
    stays, seen = [], set()
    for i in sorted(sets):
        if i not in seen:
            stays.append(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x]
    return stays


def _mixed(rows):
    """How often each (doc_id, text) of one source is taken: copies by systematic sampling over documents in order of size, in plain Python."""
    size = lambda text: len(_words(text))
    total = Counter()
    for _, text, source in rows:
        total[source] += size(text)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight, capped = {s: 1 + i % 3 for i, s in enumerate(order)}, {}
    while True:
        free, rest = sum(total.values()) - sum(capped.values()), sum(w for s, w in weight.items() if s not in capped)
        target = capped | {s: free * weight[s] / rest for s in order if s not in capped}
        over = [s for s in order if s not in capped and target[s] > 3 * total[s]]
        if not over:
            break
        capped |= {s: 3 * total[s] for s in over}
    out = Counter()
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    for s in order:
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (size(r[1]), md5("" if r[0] is None else str(r[0]))[:2], r[0] is not None, r[0] or 0))
        offset, share = int(md5(f"0:{s or ''}")[:8], 16) / 2**32, target[s] / total[s] if total[s] else 0.0
        for rank, (doc, text, _) in enumerate(own):
            out[doc, text] += math.floor((rank + 1) * share + offset) - math.floor(rank * share + offset)
    return +out


def test_pipeline_stages(spark):
    """Each stage against a plain version of its own on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mixing", "byte_bpe"]
    steps = dict(corpus_pipeline.STAGES)
    kept = common.stash(steps["language_id"](spark, docs, SF))
    model = PlainModel([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    named = {r.doc_id: model.predict(r.text) for r in docs.collect()}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (lang, score) in named.items() if lang != "und" and score >= 0.5)

    last = {}
    for r in kept.collect():
        last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    unique = common.stash(steps["exact_dedup"](spark, kept, SF))
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(last.values())

    single = common.stash(steps["simhash_near_dedup"](spark, unique, SF))
    stays = _near_kept({i: t for t, i in last.items()})
    assert single.columns == docs.columns and len(stays) < len(last) and sorted(r.doc_id for r in single.collect()) == stays

    mixed = common.stash(steps["source_mixing"](spark, single, SF))
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == _mixed([(r.doc_id, r.text, r.source) for r in single.collect()])

    final = steps["byte_bpe"](spark, mixed, SF)
    whole = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = []
    for r in mixed.collect():
        ids = whole.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, final.collect())) == sorted(want)


CLASHES = ["lang_pred", "score", "_text", "_p", "p", "row", "at", "_at", "first", "_first", "_goes", "node", "component_id", "n", "size", "copies", "_row", "ids", "target"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, name, stage):
    """Empty table, nulls in every column, ties, repeated rows and clashing names, through each stage."""
    rows = [(1, "the same words here as there", "en", "a"), (2, "the same words here as there", "en", "a"), (2, "the same words here as there", "en", "a"), (3, None, "en", "a"), (4, "", None, None), (5, " \n ", "de", "b")]
    rows += [(None, "words without an id", "en", None), (None, None, None, None), (6, "word " * 50_000, "en", "b"), (7, "1 2 ! m²", "de", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs
    for c in CLASHES:
        wide = wide.withColumn(c, F.lit(f"own {c}"))
    assert stage(spark, wide.where("false"), SF).count() == 0
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
    if name == "byte_bpe":
        assert sorted(map(repr, stage(spark, wide, SF).collect())) == sorted(map(repr, stage(spark, docs, SF).collect())) and stage(spark, wide, SF).count() == len(rows)
        return
    out = stage(spark, wide, SF)
    found = out.collect()
    assert out.columns == wide.columns and all(r[c] == f"own {c}" for r in found for c in CLASHES)
    assert sorted(map(key, found)) == sorted(map(key, stage(spark, docs, SF).collect()))
    ids = Counter(r.doc_id for r in found)
    if name == "language_id":
        assert ids == {1: 1, 2: 2, None: 1, 6: 1, 7: 1}
    if name == "exact_dedup":
        assert ids == {2: 1, 4: 1, 5: 1, None: 1, 6: 1, 7: 1}
    if name == "simhash_near_dedup":
        assert ids == {1: 1, 3: 1, None: 2, 6: 1, 7: 1}
    if name == "source_mixing":
        assert Counter((r.doc_id, r.text) for r in found) == _mixed([(r[0], r[1], r[3]) for r in rows]) and ids[6] > 0
