"""Vector codes, token alignment and exact top-k against brute force, on random tables with nulls, ties, repeats and hot values, and on the given ones."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from segspark.llm import alignment, queries, topk, vector_codes

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x string, block string, score int, code string, error string"


def _vectors(rng, n, dim, odd=True):
    """Rows with close values, so that scores and distances tie; a third of all share one vector."""
    hot = [rng.choice([-1, 0, 1, 2]) / 2 for _ in range(dim)]
    rows = [(i, hot if i % 3 == 0 else [rng.choice([-2, -1, 0, 0.3, 1]) / 2 for _ in range(dim)], rng.choice([1, 2, None])) for i in range(n)]
    if odd:
        rows += [(n, None, 1), (n + 1, [None] * dim, 2), (n + 2, [math.nan] * dim, 1), (n + 3, [math.inf] + [0.0] * (dim - 1), None), (n + 4, [0.0] * dim, None), (7, rows[7][1], rows[7][2]), (n + 5, [1.0, 2.0, 3.0], 5)]
    return [(*r, "own", "own", -1, "own", "own") for r in rows]


def _whole(rows, scale, dim):
    sound = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    return [(r[0], [math.floor(scale * float(np.float32(v))) for v in r[1]] + [0] * (dim - len(r[1])), r[2]) for r in sound]


def _codes(rows, dim, parts, entries, rounds, scale=1024):
    kept, length = _whole(rows, scale, dim), dim // parts
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda x, p: x[p * length : (p + 1) * length]
    books = [[cut(x, p) for _, x, _ in seeds] for p in range(parts)]

    def nearest(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            owned = {}
            for _, x, _ in kept:
                owned.setdefault(nearest(cut(x, p), p)[1], []).append(cut(x, p))
            books[p] = [[sum(v) // len(v) for v in zip(*owned[i], strict=True)] if i in owned else c for i, c in enumerate(books[p])]
    out, sums = [], Counter()
    for i, x, label in kept:
        best = [nearest(cut(x, p), p) for p in range(parts)]
        out.append((i, "".join(f"{b[1]:02x}" for b in best), sum(b[0] for b in best), label))
        sums[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    return sorted([(i, code, error, sums[label], sha) for i, code, error, label in out], key=repr)


def _rows(found):
    return sorted([tuple(r) for r in found.collect()], key=repr)


@pytest.mark.parametrize(("dim", "parts", "entries"), [(8, 4, 16), (6, 2, 300), (5, 4, 4)])
def test_vector_codes(spark, dim, parts, entries):
    rows = _vectors(random.Random(dim), 120, dim)
    padded = parts * -(-dim // parts)
    found = vector_codes.vector_codes(spark.createDataFrame([*rows, (None, [0.5] * dim, 9, *rows[0][3:])], VECTORS).repartition(5), parts=parts, entries=entries)
    want = _codes([*rows, (None, [0.5] * dim, 9)], padded, parts, entries, 4)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    width = max(2, len(f"{min(entries, 127) - 1:x}"))
    assert width == 2 and _rows(found) == want


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.vector_codes(none).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1), (2, [None], 1)], "vec_id long, embedding array<float>, label int")).count() == 0
    one = vector_codes.vector_codes(spark.createDataFrame([(1, [], None), (1, [], None)], "vec_id long, embedding array<float>, label int")).collect()
    assert [(r.code, r.error, r.label_error) for r in one] == [("00000000", 0, 0)] * 2


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(3)
    for top, dim in ((1 << 10, 16), (1 << 24, 7), (1 << 29, 16), (1 << 30, 1), (1 << 28, 64)):
        x, y = rng.integers(-top, top + 1, (40, dim)), rng.integers(-top, top + 1, (9, dim))
        x[0], y[0] = top, -top
        want = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in y] for u in x]
        assert vector_codes.exact_products(x, y).tolist() == want
        bits = vector_codes.limb_bits(dim)
        assert dim * (1 << 2 * bits) <= 1 << 53 and all(np.abs(limb).max() <= 1 << bits for limb in vector_codes.limbs(x, bits))
    assert len(vector_codes.limbs(np.array([[1 << 29]]), 24)) == 2 and len(vector_codes.limbs(np.array([[-(1 << 20)]]), 24)) == 1


def test_vector_codes_with_several_limbs(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-(1 << 18), 1 << 18)) for _ in range(8)], i % 2) for i in range(60)]
    found = vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), entries=8)
    assert _rows(found) == _codes(rows, 8, 4, 8, 4)
    with pytest.raises(Exception, match="don't fit 63 bits"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e12] * 8, 1), (2, [-1e12] * 8, 1)], "vec_id long, embedding array<double>, label int")).collect()


def _best(rows, dim, k, every):
    kept = {(i, tuple(x)) for i, x, _ in _whole(rows, 256, dim) if i is not None}
    out = []
    for query in sorted({i for i, _ in kept if i % every == 0}):
        scores = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), i) for own, q in kept if own == query for i, x in kept if i != query)
        out += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("dim", "block"), [(6, 20), (3, 1000), (12, 7)])
def test_exact_top(spark, dim, block):
    rows = _vectors(random.Random(dim), 150, dim) + [(None, [0.5] * dim, 9, "own", "own", -1, "own", "own"), (10, [2.0] * dim, 9, "own", "own", -1, "own", "own")]
    found = topk.exact_top(spark.createDataFrame(rows, VECTORS).repartition(5), k=5, every=10, block=block)
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and dict(found.dtypes)["rank"] == "int"
    assert _rows(found) == _best(rows, dim, 5, 10)


def test_exact_top_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.exact_top(spark.createDataFrame([], schema)).count() == 0
    assert topk.exact_top(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    rows = [(0, [1.0, 0.0], 0), (50, [0.0, 0.0], 0), (3, [-1.0, 2.0], 0), (4, [], 0)]
    assert _rows(topk.exact_top(spark.createDataFrame([r[:2] for r in rows], schema))) == _best(rows, 2, 5, 50)


def test_threshold_stops_early_and_stays_exact():
    """Long lists whose best candidates stand out: few are scored, and the result is that of scoring all."""
    rng = np.random.default_rng(8)
    x = rng.integers(-20, 20, (4000, 4))
    x[rng.integers(0, 4000, 30)] *= 50
    lists = topk.SortedLists(np.arange(4000), x)
    for query, q in ((0, x[0]), (5, np.array([3, -2, 0, 7]))):
        scores = x @ q
        want = [(int(scores[i]), int(i)) for i in np.lexsort((np.arange(4000), -scores)) if i != query][:5]
        assert lists.top(query, q, 5, None) == want and lists.seen.sum() < 1500
        assert lists.top(query, q, 5, want[2][0]) == [w for w in want if w[0] >= want[2][0]]
    big = topk.SortedLists(np.arange(3), np.array([[1 << 29], [1 << 30], [-1]]))
    assert big.top(9, np.array([1 << 30]), 2, None) == [(1 << 60, 1), (1 << 59, 0)]


A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def _aligned(texts, libraries):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), from the libraries' whole encodings and a byte by byte comparison."""
    a, b = libraries
    alphabet = alignment.byte_alphabet()
    spelled = []
    for text in texts:
        left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)] if text else []
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(x for _, x in side) != whole for side in (left, right)):
            left = right = []
        links, owners = [], []
        for side in (left, right):
            owners.append([place for place, (_, x) in enumerate(side) for _ in x])
        met = sorted(set(zip(*owners, strict=True)))
        links = [(left[i][0], right[j][0]) for i, j in met]
        ends = []
        for side in (left, right):
            ends.append(np.cumsum([len(x) for _, x in side]).tolist() if side else [])
        groups, at, places = [], [0, 0], [{end: place for place, end in enumerate(e)} for e in ends]
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = [p[end] + 1 for p in places]
            groups.append("|".join(",".join(str(i) for i, _ in side[s:e]) for side, s, e in zip((left, right), at, to, strict=True)))
            at = to
        spelled.append((len(left), len(right), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
    count = Counter(pair for s in spelled for pair in s[3])
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    return [(n_a, n_b, g, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha) for n_a, n_b, g, links, sha in spelled]


def _texts():
    rng = random.Random(6)
    words = ["the", "Straße", "naïve", "don't", "it's", "x=12;", "<s>", "<0x41>", "<|endoftext|>", "日本語", "😀", "½²", "ªº", "­", "  ", "\n\n", "\t", "a\x00b", "ﬁ", "é", "\xa0", "\x85", " ", "___", "ÀÉ", "﻿"]
    texts = [None, "", " ", "   ", "a", " a ", "▁", "a▁b", "<unk>", "same text here", "same text here", "\n", "x" * 3000, " " * 5000 + "end", "trailing   "]
    texts += ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return texts + ["".join(chr(rng.randint(0, 255)) for _ in range(400)) for _ in range(20)] + [" ".join(rng.choice(["alpha", "beta ", "gamma-delta", "12,5", "\n"]) for _ in range(20_000))]


def _digests(found):
    return sorted([tuple(r) for r in found.collect()], key=repr)


def _want(ids, texts, libraries):
    return sorted([(i, *row) for i, row in zip(ids, _aligned(texts, libraries), strict=True)], key=repr)


@pytest.mark.parametrize(("tokens", "pairs"), [(1 << 18, 1 << 20), (700, 900)])
def test_token_alignment(spark, libraries, tokens, pairs, monkeypatch):
    monkeypatch.setattr(alignment, "TOKENS", tokens)
    monkeypatch.setattr(alignment, "PAIRS", pairs)
    texts = _texts()
    ids = [None if i in (5, 9) else i for i in range(len(texts))]
    rows = [(i, t, "own", "own", -1, "own") for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, pairs string, n_a int, pair string").repartition(3)
    found = alignment.token_alignment(docs, A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert _digests(found.select(*columns)) == _want(ids, texts, libraries)
    assert alignment.token_alignment(docs.where("false"), A, B).count() == 0


def test_token_alignment_on_documents(spark, libraries):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = queries.QUERIES["op12_token_alignment"](spark, SF)
    assert _digests(found) == _want([r.doc_id for r in rows], [r.text for r in rows], libraries)


def test_text_that_is_not_utf8_has_no_tokens(spark):
    found = alignment.token_alignment(spark.createDataFrame([(1, bytearray(b"ab\xff"))], "doc_id long, text binary"), A, B)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_long_texts_encode_like_the_library(libraries, monkeypatch):
    """In pieces, with few characters a piece, the ids are those of the whole."""
    monkeypatch.setattr(alignment, "PIECE", 7)
    a, b = alignment.byte_tokenizer(A), alignment.piece_tokenizer(B)
    assert a.fast is not None and b.cuts
    for text in filter(None, _texts()):
        assert b.encode(text) == libraries[1].encode(text)
        assert a.encode(" " + text) == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_every_pair_of_latin_characters_encodes_like_the_library(libraries):
    a = alignment.byte_tokenizer(A)
    text = "".join(chr(i) + chr(j) for i in range(256) for j in range(256))
    assert a.encode(text) == libraries[0].encode(text, add_special_tokens=False).ids


def test_pair_counts_stay_in_blocks(spark):
    """One row a pair in every block, however many documents hold it."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words, "), F.col("id")).alias("text")).repartition(2)
    aligned = alignment.align(docs, A, B)
    parts = aligned.where("n_a IS NULL").select("block", F.explode("pairs").alias("pair"))
    assert parts.groupBy("block", "pair").count().where("count > 1").count() == 0
    assert aligned.where("n_a IS NULL").count() == 2
