"""Language identification, words first: log frequencies of known words, character n-grams for others.

Training counts the words of a bounded sample of labelled documents (about ``SAMPLE`` per language, by
a hash of the id) with Spark aggregates; each language keeps its most frequent words and, for every n
from ``LONGEST`` down to 1, its most frequent character n-grams of its word types: ``WORDS`` and
``GRAMS`` of them, fewer where there are so many languages that all together would pass ``TERMS``. No
language is left out. A term is stored with the languages that have it, so the model is bounded by
``TERMS`` entries for words and as many for n-grams, whatever the corpus, and can be broadcast.

A known word scores by its smoothed log frequency in each language. An unseen word scores by the mean of
its n-grams of length ``LONGEST``; a language that lacks one falls back to the n-gram's own end, a letter
shorter each time and ``BACKOFF`` less, down to a floor for a letter it lacks. Each language thus backs off
for itself, n-gram by n-gram. A document's score is the posterior of its best language, from the sum over all its words,
tempered to ``EVIDENCE`` words so that long texts are not all certain.

Words are runs of Unicode letters, lower-cased; digits, fractions and other numerals are none. Defined
results: null text and text without a letter give ``und`` with score 0; empty models (no training rows)
give ``und`` for all; equal scores go to the language that sorts first. Null ids hash like the text
``null``. Repeated rows score alike. Very long texts are scored whole, in parts. An empty table gives an
empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import shuffle_partitions, whole_row

SAMPLE = 1_500
WORDS = 20_000
GRAMS = 5_000
TERMS = 1_000_000
BROADCAST_LANGUAGES = 100_000
LONGEST = 4
BACKOFF = 4.0  # of log frequency for each letter less: more than frequencies of one length and the next lie apart
EVIDENCE = 50
LETTERS = re.compile(r"[^\W\d_]+")
BREAK = re.compile(r"[\W\d_]")
#: Characters that regular expressions count as word characters though they are neither letters nor decimal digits: ½ ² ① and the like.
NUMERALS = {ord(c): " " for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
_NUMERALS = frozenset(map(chr, NUMERALS))
UNKNOWN = "und"
CACHE = 100_000
PART = 1 << 20


def fold(doc_id: Column, n: int) -> Column:
    """The remainder of crc32(id as text) that decides what is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(n))


def words_of(text: str) -> Iterator[list[str]]:
    """The whole text's words in lists; long texts are cut between words, so no list grows with them."""
    at = 0
    while at < len(text):
        stop = at + PART
        if stop < len(text):
            stop = cut.end() if (cut := BREAK.search(text, stop)) else len(text)
        part = text[at:stop].lower()
        if not (part.isascii() or _NUMERALS.isdisjoint(part)):
            part = part.translate(NUMERALS)
        yield LETTERS.findall(part)
        at = stop


@dataclass
class Model:
    """Terms with the languages that have them: entries ``starts[r]`` to ``starts[r + 1]`` of term r."""

    languages: list[str]
    words: dict[str, int] = field(repr=False)
    grams: list[dict[str, int]] = field(repr=False)  # for n = 1 .. LONGEST
    starts: np.ndarray = field(repr=False)
    langs: np.ndarray = field(repr=False)  # int32
    logs: np.ndarray = field(repr=False)  # float64
    absent: np.ndarray = field(repr=False)  # (1 + LONGEST, languages): of a word (row 0) or n-gram (row n) that a language lacks
    met: dict[str, np.ndarray] = field(default_factory=dict, repr=False)  # n-grams scored before, of bounded size

    def gram(self, term: str) -> np.ndarray:
        """The n-gram's log frequency in each language that has it, that of its end less ``BACKOFF`` in the others."""
        row = self.met.get(term)
        if row is None:
            row = self.gram(term[1:]) - BACKOFF if len(term) > 1 else self.absent[1].copy()
            known = self.grams[len(term) - 1].get(term)
            if known is not None:
                at = slice(self.starts[known], self.starts[known + 1])
                row[self.langs[at]] = self.logs[at]
            if len(self.met) * max(1, len(self.languages)) >= 4 * CACHE:
                self.met.clear()
            self.met[term] = row
        return row

    def unseen(self, word: str) -> np.ndarray:
        """Scores of a word the model does not know."""
        padded = f" {word} "
        n = min(LONGEST, len(padded))
        last = len(padded) - n + 1
        total = np.zeros(len(self.languages))
        for at in range(0, last, PART):
            total += np.sum([self.gram(padded[i : i + n]) for i in range(at, min(last, at + PART))], axis=0)
        return total / last


def _sampled(train: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language, by hash: all where there are fewer."""
    sizes = train.groupBy("lang").agg(F.count("*").alias("n"))
    few = sizes.count() <= BROADCAST_LANGUAGES
    h = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    return train.join(sizes.hint("broadcast" if few else "merge"), "lang").filter(h * F.col("n") < per_language)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for found in words_of(text.as_py()):
                counts.setdefault(lang, Counter()).update(found)
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "term", "n"])


def _most_frequent(counts: DataFrame, keys: list[str], most: int) -> list:
    """The bounded head of ``counts`` by key; ties go to the smaller term."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank").collect()


def fit(train: DataFrame, sample: int = SAMPLE, words: int = WORDS, grams: int = GRAMS, terms: int = TERMS) -> Model:
    """Learns from (doc_id, text, lang); rows with a null text or language take no part."""
    rows = _sampled(train.select("doc_id", "text", "lang").filter("text is not null and lang is not null"), sample)
    n = shuffle_partitions(train.sparkSession)
    counts = rows.select("lang", "text").repartition(n).mapInArrow(_word_counts, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).cache()
    many = max(1, counts.select("lang").distinct().count())
    by_word = _most_frequent(counts, ["lang"], max(1, min(words, terms // many)))
    sizes = F.explode(F.lit(list(range(1, LONGEST + 1)))).alias("size")
    cut = counts.select("lang", "n", F.concat(F.lit(" "), "term", F.lit(" ")).alias("term"), sizes).filter(F.length("term") >= F.col("size"))
    cut = cut.select("lang", "size", "n", F.explode(F.sequence(F.lit(1), F.length("term") - F.col("size") + 1)).alias("at"), "term")
    cut = cut.groupBy("lang", "size", F.substring(F.col("term"), F.col("at"), F.col("size")).alias("term")).agg(F.sum("n").alias("n"))
    by_gram = _most_frequent(cut, ["lang", "size"], max(1, min(grams, terms // (many * LONGEST))))
    counts.unpersist()
    return model_of([(r["lang"], 0, r["term"], r["n"]) for r in by_word] + [(r["lang"], r["size"], r["term"], r["n"]) for r in by_gram])


def model_of(counted: list[tuple[str, int, str, int]]) -> Model:
    """The model of (language, kind, term, count); kind 0 is a word, n an n-gram of that length."""
    languages = sorted({lang for lang, kind, _, _ in counted if not kind})
    place = {lang: k for k, lang in enumerate(languages)}
    tables: list[dict[str, list[tuple[int, int]]]] = [{} for _ in range(1 + LONGEST)]
    totals = np.zeros((1 + LONGEST, len(languages)))
    for lang, kind, term, n in counted:
        tables[kind].setdefault(term, []).append((place[lang], n))
        totals[kind, place[lang]] += n
    totals += 0.5 * np.array([max(1, len(t)) for t in tables])[:, None]
    starts, langs, logs, at = [0], [], [], []
    for kind, table in enumerate(tables):
        rows = {}
        for term in sorted(table):
            rows[term] = len(starts) - 1
            for lang, n in sorted(table[term]):
                langs.append(lang)
                logs.append(np.log((n + 0.5) / totals[kind, lang]))
            starts.append(len(langs))
        at.append(rows)
    return Model(languages, at[0], at[1:], np.array(starts), np.array(langs, np.int32), np.array(logs, float), np.log(0.5 / totals))


class _Scorer:
    """A model with a bounded memory of the unseen words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.extra: dict[str, np.ndarray] = {}

    def _unseen(self, word: str) -> np.ndarray:
        row = self.extra.get(word)
        if row is None:
            if len(self.extra) * max(1, len(self.model.languages)) >= 4 * CACHE:
                self.extra.clear()
            row = self.extra[word] = self.model.unseen(word)
        return row

    def totals(self, counts: Counter) -> np.ndarray:
        """The sum over the counted words of their scores by language."""
        m = self.model
        uses = np.fromiter(counts.values(), np.int64, len(counts))
        rows = np.fromiter((-1 if r is None else r for r in map(m.words.get, counts)), np.int64, len(counts))
        known = rows >= 0
        total = m.absent[0] * uses[known].sum()
        rows, times = rows[known], uses[known]
        size = m.starts[rows + 1] - m.starts[rows]
        at = np.repeat(m.starts[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        total = total + np.bincount(m.langs[at], (m.logs[at] - m.absent[0][m.langs[at]]) * np.repeat(times, size), len(m.languages))
        if not known.all():
            for word, one in zip(counts, known.tolist(), strict=True):
                if not one:
                    total = total + counts[word] * self._unseen(word)
        return total

    def score(self, text: str) -> tuple[str, float]:
        if not self.model.languages:
            return UNKNOWN, 0.0
        total, n, counts = np.zeros(len(self.model.languages)), 0, Counter()
        for found in words_of(text):
            counts.update(found)
            n += len(found)
            if len(counts) >= CACHE:
                total, counts = total + self.totals(counts), Counter()
        if not n:
            return UNKNOWN, 0.0
        total = (total + self.totals(counts)) * (min(n, EVIDENCE) / n)
        top = int(np.argmax(total))
        return self.model.languages[top], 1.0 / float(np.exp(total - total[top]).sum())


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for b in batches:
            done = [scorer.score(text.as_py() or "") for text in b.column(1)]
            langs, best = zip(*done, strict=True) if done else ((), ())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(2, b.num_columns)), pa.array(langs, pa.string()), pa.array(best, pa.float64())], [*b.schema.names[2:], "_lang_pred", "_score"])

    return run


def predict(docs: DataFrame, model: Model, **keep: Column) -> DataFrame:
    """The ``keep`` columns of each document with (lang_pred, score). Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.lit(0).alias("_"), F.col("text").alias("_text"), *[c.alias(n) for n, c in keep.items()])
    types = StructType([*kept.schema.fields[2:], StructField("_lang_pred", StringType()), StructField("_score", DoubleType())])
    return kept.mapInArrow(_predict(shared), types)


def learn(docs: DataFrame) -> Model:
    """A model from the documents that are not held out."""
    return fit(docs.filter(fold(F.col("doc_id"), 4) != 2))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document."""
    out = predict(docs, learn(docs), doc_id=F.col("doc_id"), held_out=fold(F.col("doc_id"), 4) == 2)
    return out.select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a score of ``least``; their columns stay as they are."""
    out = predict(docs, learn(docs), row=whole_row(docs))
    return out.filter((F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= least)).select("row.*")
