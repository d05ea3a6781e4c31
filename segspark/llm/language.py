"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: The model is fitted on about so many labelled documents of a language (chosen by a hash of their id), or on all if there are fewer.
SAMPLE_DOCS = 1000
#: It knows all their words and all n-grams of these of each length from LONGEST down to 1, so the sample bounds the model.
LONGEST = 5
#: Unseen words whose scores a worker remembers.
WORD_CACHE = 200_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; other numerals, such as a raised two, end a run as digits do."""
    found = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [run for word in found for run in "".join(c if c.isalpha() else " " for c in word).split()]


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from: CRC-32 of the id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _word_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts.update((lang, w) for w in words_of(text.as_py()))
            keys = list(counts)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _gram_counts(words: DataFrame) -> DataFrame:
    """(lang, size, gram, n): every distinct n-gram of a word counts as often as the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                padded = f"<{word}>"
                for size in range(1, LONGEST + 1):
                    for gram in {padded[i : i + size] for i in range(len(padded) - size + 1)}:
                        counts[lang, size, gram] += n
            langs, sizes, grams = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(grams, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "size", "gram", "n"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies per language of words and of n-grams of each length."""

    def __init__(self, langs: list[str], tables: list[dict[str, dict[str, int]]], totals: list[dict[str, int]]):
        """tables: of words, then of n-grams of LONGEST to 1 characters: language -> key -> count; totals: the sums of all counts."""
        self.langs = langs
        self.rows: list[dict[str, int]] = []  # of each level: key -> row of its scores
        self.scores: list[np.ndarray] = []
        for table, total in zip(tables, totals, strict=True):
            rows: dict[str, int] = {}
            for counts in table.values():
                for key in counts:
                    rows.setdefault(key, len(rows))
            scores = np.full((len(rows), len(langs)), 0.5)
            for at, lang in enumerate(langs):
                counts = table.get(lang, {})
                scores[[rows[k] for k in counts], at] += np.fromiter(counts.values(), dtype=float, count=len(counts))
            sums = np.array([total.get(lang, 0) + 0.5 * (len(rows) + 1) for lang in langs])
            self.rows.append(rows)
            self.scores.append(np.log(scores) - np.log(sums))

    def backoff(self, word: str) -> np.ndarray | None:
        """Log scores per language of a word that isn't known: the mean of its known n-grams of the greatest length that has any; None if not even one of its characters is known."""
        padded = f"<{word}>"
        for level, n in enumerate(range(LONGEST, 0, -1), 1):
            get = self.rows[level].get
            found = [row for i in range(len(padded) - n + 1) if (row := get(padded[i : i + n])) is not None]
            if found and (n > 1 or any(c in self.rows[level] for c in word)):
                return self.scores[level][found].mean(axis=0)
        return None

    def word(self, word: str) -> np.ndarray | None:
        """Log scores of a word per language."""
        row = self.rows[0].get(word)
        return self.backoff(word) if row is None else self.scores[0][row]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share (0 to 1) of the languages' likelihoods; und and 0 for texts without letters."""
        if self._scorer is None:
            self._scorer = Scorer(self)
        return self._scorer.predict(text)

    _scorer: Scorer | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_scorer"}


class Scorer:
    """A worker's table of word scores: known words, and the unseen words that it has met lately."""

    def __init__(self, model: Model):
        self.model = model
        self.known = len(model.rows[0])
        self.scores = np.zeros((self.known + 1 + WORD_CACHE, max(1, len(model.langs))))
        if model.langs:
            self.scores[: self.known] = model.scores[0]
        self.nothing = self.known  # the row of what no language knows
        self._forget()

    def _forget(self) -> None:
        self.unseen: dict[str, int] = {}
        self.next = self.known + 1

    def row(self, word: str) -> int:
        """The row of a word that isn't known."""
        row = self.unseen.get(word)
        if row is None:
            scores = self.model.backoff(word) if self.model.langs else None
            row = self.nothing if scores is None else self.next
            if scores is not None:
                self.scores[row], self.next = scores, row + 1
            self.unseen[word] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        if max(self.next, self.known + len(self.unseen)) + len(text or "") >= len(self.scores):
            if len(text or "") >= WORD_CACHE:  # a text that may hold more new words than there are places
                self.scores = np.concatenate([self.scores, np.zeros((len(text), self.scores.shape[1]))])
            self._forget()
        get, row = self.model.rows[0].get, self.row
        found = np.array([row(w) if (at := get(w)) is None else at for w in words_of(text)], dtype=np.int64)
        if not self.model.langs or not len(found):
            return UNKNOWN, 0.0
        totals = self.scores[found].sum(axis=0)
        best = int(totals.argmax())
        return self.model.langs[best], float(1 / np.exp(totals - totals[best]).sum())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit the model on the labelled documents that are not held out.

    At most about SAMPLE_DOCS documents a language are read, by a hash of their id; counts are aggregated by Spark, and the tables of the
    sample's words and n-grams reach the driver. Labels are taken as they are, one language for each distinct value.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], [{}] * (LONGEST + 1), [{}] * (LONGEST + 1))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, SAMPLE_DOCS / n))]), F.col("lang"))
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) / float(1 << 20)
    counts = stash(_word_counts(rows.where(place < share)), "words")
    by_gram = stash(_gram_counts(counts), "grams")
    tables: list[dict[str, dict[str, int]]] = [{} for _ in range(LONGEST + 1)]
    totals: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    for level, frame in [(F.lit(0), counts.withColumnRenamed("word", "key")), (LONGEST + 1 - F.col("size"), by_gram.withColumnRenamed("gram", "key"))]:
        found = frame.select(level.cast("int").alias("level"), "lang", "key", "n").toArrow()
        for at, lang, key, n in zip(*(c.to_pylist() for c in found.columns), strict=True):
            tables[at].setdefault(lang, {})[key] = n
            totals[at][lang] = totals[at].get(lang, 0) + n
    return Model(sorted(sizes), tables, totals)


def _predicted(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """(row: all columns of docs, p: lang_pred and score); map-only. The text is all that a prediction sees."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.select(F.struct("*").alias("row"), predict(F.col(text_col).cast("string")).alias("p"))


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with the columns lang_pred and score, which replace columns of these names."""
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return _predicted(docs, model, text_col).select(*others, "p.lang_pred", "p.score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Null texts and texts without letters are und with score 0, as is everything if no row is labelled. Words of unknown characters
    only count for no language; if no word counts, all languages are equal. Ties go to the first language by name. Null ids are not held
    out and not learned from. All words of texts of any length are scored. Rows that repeat are scored alike, and learned from as often as they occur. Other columns are ignored. An empty table gives none.
    """
    model = train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_language(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is identified with a score of at least least, with all their columns, whatever their names.

    Null, empty and letterless texts go, and so does everything if no row is labelled; the rest as identify() says. Rows that repeat stay or go
    together. An empty table gives none.
    """
    model = train(docs, id_col, text_col, lang_col)
    named = _predicted(docs, model, text_col)
    return named.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least)).select("row.*")
